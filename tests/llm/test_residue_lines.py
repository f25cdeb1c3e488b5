from sheaf.llm import lines, residue

BLOCK = "block_id long, extraction_id string, page_id long, url string, text string, source string, key string"


def blocks(spark, rows):
    return spark.createDataFrame([(i, "e", p, u, t, "clash", "clash") for i, (p, u, t) in enumerate(rows)], BLOCK)


def site(page):
    return f"https://A{'' if page % 2 else ''}.test/p/{page}" if page % 3 else f"HTTPS://a.TEST/p/{page}"


def test_repeated_lines_by_letters(spark):
    rows = [(p, site(p), f"Body of {'abcdefghij'[p]} page\n» Share  THIS, 12 times\nab\n") for p in range(10)]
    rows += [(10, "https://other.test/", "share this times"), (11, None, "share this times"), (12, "https://a.test/", None), (13, "https://a.test/", "")]
    df = blocks(spark, rows)
    got = {(r.block_id, r.line_no) for r in lines.repeated_block_lines(df.union(df.limit(3))).collect()}
    assert got == {(p, 1) for p in range(10)}
    clean = {r.block_id: (r.text, r.removed) for r in lines.without_repeated_lines(df).collect()}
    assert clean[0] == ("Body of a page\nab\n", 1) and clean[10] == ("share this times", 0) and clean[12] == (None, 0) and clean[13] == ("", 0)
    assert lines.repeated_block_lines(df.limit(0)).count() == 0


def test_thresholds_are_exact(spark):
    three = [(p, site(p), "legal notice") for p in range(3)] + [(p, site(p), "own text %s" % "abcdefghij"[p]) for p in range(3, 10)]
    assert lines.repeated_block_lines(blocks(spark, three)).count() == 0  # 30 %, but three pages
    four = three + [(3, site(3), "Legal Notice!")]
    assert lines.repeated_block_lines(blocks(spark, four)).count() == 4
    low = four + [(p, site(p), "more %s" % ("x" * (p - 9))) for p in range(10, 14)]
    assert lines.repeated_block_lines(blocks(spark, low)).count() == 0  # four of fourteen pages


def test_one_site_with_most_rows(spark):
    rows = [(p, "https://big.test/%d" % p, "menu line\nown %s" % "".join("abcdefghij"[int(c)] for c in str(p))) for p in range(3000)]
    assert lines.repeated_block_lines(blocks(spark, rows)).count() == 3000


CASES = [
    "With {{ product }}, teams plan.", "${price} locks counts.", "With [INSERT CITY], buyers map.", "With [Company Name], buyers map.", "[object Object] archives", "With undefined, staff rate forms.", "XXXXX locks orders", "__HEADLINE__ merges", "With (logo url TBD), we go.",
    "Lorem ipsum dolor sit amet", "Magnar elitum dorat lorem comodo.", "Your headline goes here.", "The final intro (placeholder)", "Sample text - replace before going live.", "(content pending review)", "Votre texte ici. Cliquez pour modifier.", "TODO: write the proof part",
    "As a language model I cannot see the source of this section.", "Error while generating section 'hook': request timed out", "404 - Page not found", "Fehler 404: Seite nicht gefunden", "Access denied. Your request was blocked (ref 7).", "Votre session a expiré.",
    "An unexpected error occurred.", "Please sign in to continue.", "Cette page n'existe plus.", "Please wait", "Checking your browser before you continue.", "You need to enable scripts to run this app.", "Les scripts sont désactivés, le contenu reste vide.", "Kindly switch on JavaScript to use the app", "<p>502 Bad Gateway</p>", "Uncaught exception in module x at line 3",
]
NO_CASES = [
    "The mail editor accepts merge fields such as {{price}}, and it fills them.", "Template authors write [date] in square brackets; empty fields are listed.", "const msg = `Hello ${price}`;", "{% for row in visits %}{{ row.total }}{% endfor %}",
    "If a visitor reads 'access denied' at the door, staff renew the badge.", "When a session expires, the notebook keeps unsaved notes [2].", "The browser kit is written in JavaScript and needs 10 kilobytes.", "Where scripts are disabled by policy, plain pages are shown.",
    "Our error tracker groups 404 and 502 answers by route.", "A custom page-not-found screen sends visitors back.", "During planned maintenance the timer stays readable.", "Designers may keep filler text in a draft.", "Todo Track and Loremo Studio sort orders.",
    "Rate limits: the meter answers 429 after that.", "In Zatevu, 50 clerks rename visits.", "", "   ",
]


def records(spark, texts, source="s"):
    rows = [("content_blocks", i, source, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "item_kind string, item_id long, source string, page long, text string")


def test_evidence(spark):
    got = {r.item_id for r in residue.residue_records(records(spark, CASES)).collect()}
    assert [c for i, c in enumerate(CASES) if i not in got] == []
    got = {r.item_id for r in residue.residue_records(records(spark, NO_CASES)).collect()}
    assert [c for i, c in enumerate(NO_CASES) if i in got] == []


def test_boilerplate_is_subtracted_where_there_is_other_copy(spark):
    note = "Please enable JavaScript to view this page."
    texts = [f"{note}\nReal copy number {'abcdefgh'[i]}" for i in range(6)] + [note, "Other copy", None]
    got = {r.item_id for r in residue.residue_records(records(spark, texts)).collect()}
    assert got == {6}
    assert {r.item_id for r in residue.residue_records(records(spark, texts, None)).collect()} == set(range(7))
    few = [f"{note}\nReal copy", "Other copy"]
    assert {r.item_id for r in residue.residue_records(records(spark, few)).collect()} == {0}


def test_long_repeated_and_empty(spark):
    df = records(spark, ["word " * 200_000 + "\n{{name}} here"])
    assert [r.kinds for r in residue.residue_records(df.union(df)).collect()] == [["field"]]
    assert residue.residue_records(df.limit(0)).count() == 0

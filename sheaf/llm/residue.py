"""Records that hold template residue, filler, or an error or needs-scripts message.

Every line with evidence is found in one pass over the whole texts: an automaton
of literals derived from the patterns picks the texts worth reading closely,
patterns then judge their sentences. Lines are counted by source with page bitmaps; evidence in a line
that is boilerplate of its source (it stands on a large share of the pages) is
subtracted where the record has other copy, and the records whose residual
still holds evidence are excluded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.keys import host
from sheaf.llm import lines
from sheaf.llm.literals import Prefilter
from sheaf.session import stored

# Marks of unfilled fields.
FIELDS = (
    r"\{\{[^{}\n]*\w[^{}\n]*\}\}", r"[$#]\{[^{}\n]*\w[^{}\n]*\}", r"\{%\s*\w[\w .]*%\}", r"<%=?\s*[\w .\-]+%>",
    r"\[\[\s*[\w .\-]+\s*\]\]", r"@@\s*\w+\s*@@", r"(?<![\w%])%[A-Za-z]\w+%(?![\w%])", r"(?<!\w)__[A-Za-z]\w*[A-Za-z0-9]__(?!\w)",
    r"«[A-Z][A-Z_ ]+»", r"(?<![\w$])\$[A-Z][A-Z_]+\$", r"(?<![\w{$#])\{[A-Za-z][\w ]*\}(?!\})", r"\[(?i:insert|add|enter|your)\b[^\]\n]*\]",
    r"(?<!\w)\[[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}\](?!\()", r"<[a-z][a-z_ ]* here>", r"<(?:missing|insert|add|your) [a-z_ ]+>", r"&lt;\s*[\w ]+\s*&gt;",
    r"\([\w ]+ (?:TBD|TBC|TODO|TBA)\)", r"(?<!\w)X{3,}(?!\w)", r"\[object Object\]", r"(?:^|[.!?:;]\s+|\b[Ww]ith )(?:[Uu]ndefined|NaN|[Nn]ull)(?=[ ,]\w*|[ ,.])(?! (?:behaviou?r|values?|pointers?|and void)\b)",
)
# Words by which a sentence describes fields instead of holding one.
DESCRIBED = r"\b(?:merge fields?|fields? such as|every field|template authors?|square brackets|curly|placeholders? (?:such|like|are)|felder wie|platzhalter wie|champs? comme|campos? como|syntax)\b"
# Marks of code samples.
CODE = r"`|=>|^\s*(?:const|let|var|import|from|def|return|curl|function|SELECT)\b|[;{]\s*$|^\s*(?:if|for|while)\s*\(|\{%\s*(?:for|if|end\w+|block|include|set)\b"

# Words of the usual filler text and of its generators.
FILLER_WORDS = """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint
occaecat cupidatat non proident sunt culpa officia deserunt mollit anim est laborum pellentesque habitant morbi tristique senectus netus malesuada fames
turpis egestas vestibulum tortor quam feugiat vitae ultricies eget ante donec libero semper aenean mauris placerat eleifend leo quisque sapien
autem condimentum ornare porta nullam varius vivamus sagittis lacus vel augue laoreet rutrum faucibus auctor cras mattis purus fermentum maecenas diam blandit
fusce dapibus tellus cursus justo odio integer posuere erat venenatis curabitur praesent nibh euismod suspendisse potenti nunc lectus phasellus viverra
ligula tincidunt etiam porttitor hendrerit neque convallis pulvinar vulputate sollicitudin felis risus massa imperdiet interdum ullamcorper""".split()
# Share of such words (misspelled ones too), words of a sentence, and undoubted ones that make it filler.
FILLER_SHARE, FILLER_LEAST, FILLER_SURE = 0.5, 4, 3

_PART = r"(?:headline|teaser|claim|intro(?:duction)?|captions?|body(?: text| copy)?|quote|text|copy|content|title|sub-?title|paragraph|description|summary|slogan|bullet|section)"
# Stand-in text and editing notes.
STAND_IN = (
    r"\blorem ipsum\b", rf"^\W*(?:this is (?:an?|some) )?(?:dummy|sample|placeholder|test|filler|demo|stand-in) {_PART}\b(?!s? (?:in|of|that|which|stays?|is kept))",
    rf"\b{_PART} (?:goes here|comes in here|comes here|to follow|to come|text text\b|- ?replace me|\(?placeholder\)?(?:\W|$)|\(waiting for\b)", r"\breplace (?:me|before (?:going live|publishing|launch))\b", r"\bclick to edit\b", rf"\b(?:add|enter|type|insert|put|write) your {_PART} here\b", rf"^\W*(?:your|main|short|second|first|final) {_PART}(?: goes)? here\b",
    r"\bdescribe your \w+ in \w+ (?:sentences?|words)\b", r"^\W*add an? (?:short|brief) description\b", r"\btext text text\b", r"\btest test test\b", r"\basdf\b", r"\bqwertz?\b", r"\b(?:content|copy|text) pending (?:review|approval)\b",
    r"^\W*(?:todo|tbd|tbc|fixme)\b\s*[:\-]", r"\b(?:marketing|design|legal|sales|editors?|copywriters?|(?:the )?client) (?:will|must|has to|have to) (?:send|supply|provide|deliver|write|fill)\b", r"\bblindtext\b", r"\bplatzhalter(?:text)?\b(?! wie)", r"\b(?:überschrift|text|titel|beschreibung) (?:hier )?einfügen\b", r"\bhier (?:steht|folgt|kommt) (?:später|noch|bald)? ?\w* ?\w*text\b",
    r"\bvor dem (?:start|livegang) ersetzen\b", r"\bzum bearbeiten klicken\b", r"\btexte (?:provisoire|factice|d'exemple)\b", r"\bvotre (?:texte|titre|contenu) ici\b", r"\bcliquez pour modifier\b", r"\bà (?:remplacer|compléter) avant\b", r"\btexto (?:de muestra|provisional|de relleno|de ejemplo)\b",
    r"\b(?:aquí va|tu) (?:el |la )?(?:texto|título|contenido)\b(?: aquí| de la sección| del?)", r"\bsustituir antes de publicar\b", r"\bhaz clic para editar\b",
)

# Messages of a failed generation.
FAILED = (
    r"\bas an? (?:ai|large|language)\b.*?\bmodel\b,? i\b", r"\b(?:content|section|text|summary|answer) could not be (?:generated|created|loaded)\b", r"\berror while generating\b", r"\bi(?:'m| am) (?:sorry|unable),? (?:but )?i? ?(?:can(?:no|')t|to (?:generate|help|write))\b",
    r"\bgeneration (?:failed|timed out)\b",
)

# Error, blocking, login and waiting pages.
ERROR_PAGE = (
    r"\b(?:error|fehler|erreur) ?[45]\d\d ?[:\-–]", r"^\W*(?:p>)?http(?: error| status)?(?:/\d(?:\.\d)?)? ?[45]\d\d\b", r"\bseite existiert (?:leider )?nicht\b", r"\bfehler ist aufgetreten\b", r"\berreur (?:interne |inattendue )?(?:est survenue|s'est produite)\b", r"\bse ha producido un error\b", r"^\W*[45]\d\d\s*[-–|:]\s*\w", r"^\W*(?:<\w+>)?[45]\d\d (?:bad gateway|not found|forbidden|internal server error|service unavailable|gateway time-?out|unauthorized)\b", r"^\W*(?:p>)?(?:internal server error|bad gateway|service unavailable|gateway time-?out|page not found)\b",
    r"\bpage not found\b(?! screen)", r"\bcould not find the page\b", r"\bcan(?:'t|not) seem to find\b", r"\bdoes not exist on this (?:server|site)\b", r"\bno route matches\b", r"^\W*(?:p>)?gone: /", r"\bwas removed by its owner\b", r"\b(?:page|resource|document) (?:has been|was) (?:moved|removed|deleted)\b", r"\brequested (?:resource|page|url) \w+ \w+",
    r"\bconnection to \S+ (?:was )?(?:refused|reset|timed out)\b", r"\byour (?:request|access|ip)(?: address)? (?:was|has been|is) blocked\b", r"\bchecking your browser\b", r"\bplease (?:confirm|verify) (?:that )?you are (?:a )?human\b", r"\b(?:are|is) you (?:a )?human\b", r"^\W*(?:p>)?(?:please wait|just a moment|one moment)\b\W*(?:this|while|$|<)",
    r"^\W*(?:p>)?this takes a few seconds", r"^\W*(?:p>)?(?:oops|whoops)\b", r"\bsomething went wrong\b", r"^\W*(?:p>)?too many requests\b", r"\bslow down and retry\b", r"\b(?:you have|you've) reached your limit\b", r"\bplease try again in \d+", r"\btry again later\b", r"\byour session (?:has )?(?:expired|timed out)\b", r"\bplease (?:sign|log) in again\b",
    r"\blog ?in required\b", r"\byou (?:must|need to|have to) (?:be logged in|log in|sign in) to\b", r"^\W*(?:p>)?forbidden\b\s*[:\-.!]", r"\byou (?:don't|do not) have permission\b", r"^\W*(?:p>)?access denied\b", r"\bcould not connect to (?:the )?database\b", r"\buncaught (?:exception|error|\w*error)\b", r"\bstack trace\b", r"\bupstream (?:timed out|error|connect)\b",
    r"\bbackend fetch failed\b", r"\b(?:down|offline) for maintenance\b", r"\b(?:service|site|page|server) is (?:temporarily|currently) (?:unavailable|down)\b", r"^\W*(?:p>)?under maintenance\b", r"\bzugriff verweigert\b", r"\b(?:ihre )?sitzung ist abgelaufen\b", r"\bseite (?:wurde )?nicht gefunden\b", r"\bseite ist (?:leider )?nicht mehr (?:vorhanden|verfügbar)\b", r"\bwartungsarbeiten\b",
    r"\b(?:dienst|seite) ist (?:derzeit|momentan|vorübergehend) nicht (?:verfügbar|erreichbar)\b", r"\baccès refusé\b", r"\bvotre session a expiré\b", r"\bpage (?:introuvable|non trouvée)\b", r"\bservice est (?:momentanément|temporairement) indisponible\b", r"\bmaintenance en cours\b", r"\bacceso denegado\b", r"\bsesión ha (?:caducado|expirado)\b", r"\bpágina no encontrada\b",
    r"\bservicio no está disponible\b", r"\ben mantenimiento\b", r"\ban (?:unexpected |internal |unknown )?error (?:has )?occurred\b", r"\brate limit (?:exceeded|reached)\b", r"\bunusual traffic\b", r"\b(?:complete|solve|enter) the captcha\b", r"\bray id\b",
    r"\b(?:sign|log) in to (?:continue|view|read|proceed)\b", r"^\W*(?:p>)?(?:this (?:site|page) is )?under construction\b", r"\bmelden sie sich an,? um\b", r"\bveuillez vous connecter\b", r"\binicia sesión para\b", r"\bpage (?:n'existe (?:pas|plus)|ya no existe)\b", r"\bpágina (?:no|ya no) existe\b",
)

_SCRIPT = r"(?:java ?scripts?|scripts?|scripting|active (?:scripts?|content|scripting)|js)"
# Requests to turn scripts on.
NEEDS_SCRIPTS = (
    rf"\b(?:please|kindly|must|need to|to go on,?|have to|should|activate|enable)\b.{{0,20}}\b(?:enable|activate|turn on|switch on|allow|activated?|permit)\s+{_SCRIPT}\b", rf"\b(?:please|kindly|must|need to|have to) {_SCRIPT}\b", rf"\b{_SCRIPT} (?:is|are) (?:disabled|off|turned off|switched off|blocked|required|not enabled)\b(?! by policy)", rf"\b(?:does not|doesn't|cannot) (?:support|run) {_SCRIPT}\b",
    rf"\bwithout {_SCRIPT}(?:\W*$|\W*<|\. )", rf"\bturn it on and reload\b", rf"\b(?:requires?|needs?|works best with) {_SCRIPT}\b(?! and needs)", rf"\baktivieren sie (?:bitte )?{_SCRIPT}\b", rf"\bohne (?:skripte?|{_SCRIPT})\b", rf"\b(?:skripte?|{_SCRIPT}) (?:ist|sind) (?:deaktiviert|ausgeschaltet)\b", rf"\b(?:activer|autoriser) (?:les )?{_SCRIPT}\b",
    r"\bscripts sont désactivés\b", rf"\bactiva(?:r|e)? (?:los )?{_SCRIPT}\b", r"\b(?:necesita|requiere) (?:scripts|javascript)\b", rf"\bnécessite (?:les scripts|{_SCRIPT})\b", rf"\bbenötigt (?:skripte|{_SCRIPT})\b",
)

KINDS = ("field", "filler", "failed", "error", "scripts")


# The patterns with their kinds and flags; the Judge and its prefilter know them by place.
PATTERNS = [("field", p, 0) for p in FIELDS] + [(kind, p, re.I) for kind, some in (("filler", STAND_IN), ("failed", FAILED), ("error", ERROR_PAGE), ("scripts", NEEDS_SCRIPTS)) for p in some]


class Judge:
    """The patterns, compiled once per worker."""

    def __init__(self) -> None:
        self.patterns = [(kind, re.compile(p, flags)) for kind, p, flags in PATTERNS]
        self.described = re.compile(DESCRIBED, re.I)
        self.code = re.compile(CODE)
        self.words = re.compile(r"[^\W\d_]+")
        self.filler = frozenset(FILLER_WORDS)
        self.holes = {(i, w[:i] + w[i + 1 :]) for w in FILLER_WORDS if len(w) >= 4 for i in range(len(w))}
        self.shorter = {w for _, w in self.holes}
        self.known: dict[str, bool] = {}
        self.sentences = re.compile(r"(?<=[.!?])\s+")

    def stem(self, word: str) -> bool:
        """A filler word, also with an ending of one or two letters."""
        return word in self.filler or word[:-1] in self.filler or word[:-2] in self.filler

    def latin(self, word: str) -> bool:
        """A filler word with an ending, or with one letter (of four or more) left out, put in or changed."""
        got = self.known.get(word)
        if got is None:
            less = [word[:i] + word[i + 1 :] for i in range(len(word))]
            near = len(word) >= 4 and (word in self.shorter or any(w in self.filler or (i, w) in self.holes for i, w in enumerate(less)))
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[word] = self.stem(word) or near
        return got

    def kinds(self, line: str, suspects: Iterable[int] | None = None, words: bool = True) -> list[str]:
        """Kinds of evidence in a line; empty for none. suspects, words: the patterns that may match, and whether filler words may be there (else all are tried)."""
        if self.code.search(line):
            return []
        found = set()
        tried = self.patterns if suspects is None else [self.patterns[i] for i in suspects]
        for s in self.sentences.split(line.strip()):
            if words:
                own = self.words.findall(s.lower())
                if len(own) >= FILLER_LEAST and sum(map(self.stem, own)) >= FILLER_SURE and sum(map(self.latin, own)) >= FILLER_SHARE * len(own):
                    found.add("filler")
            for kind, p in tried:
                if kind not in found and p.search(s) and (kind != "field" or not self.described.search(s)):
                    found.add(kind)
        return [k for k in KINDS if k in found]


@cache
def _prefilter() -> Prefilter:
    """Once per worker: the texts and lines in which the Judge may find evidence, and more."""
    return Prefilter([(p, flags) for _, p, flags in PATTERNS], FILLER_WORDS, FILLER_SURE)


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines with evidence: their record, source, page, letters and whether other lines with letters stand in the record."""
    texts = _prefilter()
    judge = Judge()
    for rows in batches:
        out = []
        for i, text in enumerate(rows["text"].str.replace("\xa0", " ", regex=False).to_numpy()):
            if not text or not texts.may(text):
                continue
            parts = text.split("\n")
            found = [(p, k) for p in parts if any(may := texts.suspects(p)) and (k := judge.kinds(p, *may))]
            if found:
                full = sum(any(c.isalpha() for c in p) for p in parts)
                out += [(i, p, k, full <= len(found)) for p, k in found]
        if not out:
            continue
        picked = rows.iloc[[o[0] for o in out]]
        yield pd.DataFrame({
            "item_kind": picked["item_kind"].to_numpy(), "item_id": picked["item_id"].to_numpy(), "source": picked["source"].to_numpy(), "page": picked["page"].to_numpy(),
            "line": [o[1] for o in out], "kinds": [o[2] for o in out], "alone": [o[3] for o in out],
        })


def residue_records(records: DataFrame) -> DataFrame:
    """Records with evidence: item_kind, item_id, kinds (sorted array).

    records has item_kind, item_id, source (string), page (long) and text. Null
    and empty texts hold nothing. A null source has no boilerplate to subtract.
    Records sent twice give one row. Lines with evidence are counted on all pages
    of their source; a line that is boilerplate there (at least lines.LEAST_PAGES
    pages and lines.LEAST_SHARE of the source's pages) is subtracted from records
    that have other copy, and judged where the record is nothing else.
    """
    slim = records.select("item_kind", "item_id", F.xxhash64("source").alias("source"), F.col("page").cast("long").alias("page"), "text", F.col("source").isNotNull().alias("_known"))
    pages = slim.where("_known")
    kept = slim.select("item_kind", "item_id", F.when(F.col("_known"), F.col("source")).alias("source"), "page", "text").where("text IS NOT NULL AND text <> ''")
    schema = "item_kind string, item_id long, source long, page long, line string, kinds array<string>, alone boolean"
    bad = stored(kept.mapInPandas(_evidence, schema).select("*", F.xxhash64("source", lines.letters(F.col("line"))).alias("key")).drop("line"), "residue")
    whole = lines.cardinality(lines.page_bits(pages.select("source", "page"), "source"), "source").select(F.col("source").alias("_s"), F.col("pages").alias("_all"))
    counts = lines.cardinality(lines.page_bits(bad.where("source IS NOT NULL"), "source", "key"), "source", "key").where(F.col("pages") >= lines.LEAST_PAGES)
    usual = counts.join(whole, F.col("source") == F.col("_s")).where(F.col("pages") * lines.LEAST_SHARE[1] >= F.col("_all") * lines.LEAST_SHARE[0])
    left = bad.where("alone").unionByName(bad.where("NOT alone").join(usual.select("key"), "key", "left_anti"))
    return left.select("item_kind", "item_id", F.explode("kinds").alias("kind")).groupBy("item_kind", "item_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def block_records(blocks: DataFrame) -> DataFrame:
    """Blocks as records; their source is the host of the url, else the extraction."""
    source = F.coalesce(host(F.col("url")), F.col("extraction_id"))
    return blocks.select(F.lit("content_blocks").alias("item_kind"), F.col("block_id").alias("item_id"), source.alias("source"), F.col("page_id").alias("page"), "text")


def section_records(sections: DataFrame) -> DataFrame:
    """Pitch sections as records; their source is the product, their page the pitch."""
    return sections.select(F.lit("pitch_sections").alias("item_kind"), F.col("section_id").alias("item_id"), F.col("product_id").alias("source"), F.col("pitch_id").alias("page"), F.col("content").alias("text"))


def all_records(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks and pitch sections as records."""
    return block_records(blocks).unionByName(section_records(sections))

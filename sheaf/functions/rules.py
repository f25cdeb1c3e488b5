"""Rule classification: content classes, image kinds, frameworks, table kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content classes in order; the last class that matches wins.
CONTENT = {
    "feature": ["feature", "capability", "what you.+get", "includes"],
    "benefit": ["benefit", "advantage", "why choose", "you.+will"],
    "testimonial": ["testimonial", "what.+customers.+say", "review", "case study"],
    "pricing": ["pricing", "plans?", "packages?", r"\$\d+", "per month", "annually"],
    "cta": ["get started", "sign up", "try.+free", "request.+demo", "contact.+us", "learn more"],
}
# Kinds of images, each a flag of its own.
IMAGES = {
    "is_logo": ["logo", "brand", "icon-logo"],
    "is_icon": ["icon", "favicon", "glyph", "sprite"],
    "is_screenshot": ["screenshot", "screen-?shot", "preview", "demo", "product-image"],
    "is_diagram": ["diagram", "chart", "graph", "flow", "architecture", "workflow"],
}
# Parts of the urls of tracking images.
TRACKING = ["google-analytics", "facebook.com/tr", "pixel", "beacon", "tracking"]
# Marks of frameworks in page sources; the first framework that matches wins.
FRAMEWORKS = {
    "react": r"data-reactroot|data-reactid|id=\"__next\"|<script[^>]*src=\"[^\"]*(react|next)",
    "vue": r"data-v-app|data-v-|id=\"__nuxt\"|<script[^>]*src=\"[^\"]*(vue|nuxt)",
    "angular": r"ng-version|_ngcontent|<script[^>]*src=\"[^\"]*angular|ng-app",
    "svelte": r"<script[^>]*src=\"[^\"]*svelte|class=\"[^\"]*svelte-",
    "ember": r"id=\"ember\"|<script[^>]*src=\"[^\"]*ember",
}
APP_ROOT = r"id=\"(app|root|__app|__root)\""
# The second, finer order of frameworks for whole sites, with the marks of each.
SITE_FRAMEWORKS = {
    "nextjs": r"id=\"__next\"|__NEXT_DATA__",
    "nuxt": r"id=\"__nuxt\"|__NUXT__",
    "react": r"data-reactroot|data-reactid",
    "vue": r"data-v-app|data-v-",
    "angular": r"ng-version|_ngcontent",
    "svelte": r"class=\"[^\"]*svelte-",
}
# Words and cells of comparison and of price tables.
COMPARISON_WORDS = ["compare", "comparison", "vs", "versus", "differences", "feature", "plan", "tier"]
COMPARISON_CELLS = ["✓", "✗", "✔", "✘", "yes", "no", "included", "•", "x", "-"]
OFFER_WORDS = ["compare", "comparison", "pricing", "plan", "tier", "feature", "basic", "pro", "enterprise", "free", "premium", "standard"]
OFFER_MARKS = ["✓", "✗", "✔", "✘", "yes", "no", "included", "×"]
PRICE_WORDS = ["price", "pricing", "cost", "plan", "tier", "monthly", "annually", "year", "free", "pro", "enterprise", "basic", "premium", "starter", "$", "€", "£"]
PRICE_MARKS = [r"\$\d+", r"€\d+", r"£\d+", r"\d+/mo", r"\d+/month", r"\d+/year", "free", "contact"]


def any_of(patterns: list[str]) -> str:
    return "|".join(f"({p})" for p in patterns)


def has_any(text: Column, literals: list[str]) -> Column:
    """Whether a text holds one of the literals, anywhere; null holds none."""
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in literals]), lambda x: F.contains(text, x)), F.lit(False))


def last_match(text: Column, classes: dict[str, list[str]], other: Column) -> Column:
    """The last class of which a pattern matches."""
    out: Column | None = None
    for name, patterns in reversed(classes.items()):
        hit = text.rlike(any_of(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def first_match(text: Column, classes: dict[str, str], other: Column) -> Column:
    """The first class whose pattern matches."""
    out: Column | None = None
    for name, pattern in classes.items():
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def content_class(kind: Column, text: Column, parent: Column) -> Column:
    """Class by the words of text and parent section; headings and texts without a match keep their kind."""
    low = F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "), F.lower(F.coalesce(parent, F.lit(""))))
    return F.when(kind == "heading", kind).otherwise(last_match(low, CONTENT, kind))


def image_flags(classes: Column, url: Column) -> list[Column]:
    """One boolean per kind of image, from class names and url together."""
    low = F.concat(F.lower(F.coalesce(classes, F.lit(""))), F.lower(F.coalesce(url, F.lit(""))))
    return [low.rlike(any_of(p)).alias(n) for n, p in IMAGES.items()]


def keeps_image(url: Column, width: Column, height: Column, min_width: int = 50, min_height: int = 50) -> Column:
    """Whether an image stays, given columns is_logo, is_icon, is_screenshot and is_diagram; unknown sizes count as 0."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    low = F.lower(url)
    return F.coalesce(
        F.when(F.startswith(url, F.lit("data:")) | has_any(low, TRACKING), False)
        .when(F.col("is_logo") | F.col("is_diagram") | F.col("is_screenshot"), True)
        .when(F.col("is_icon") & (w < 100) & (h < 100), False)
        .otherwise(~((w > 0) & (w < min_width)) & ~((h > 0) & (h < min_height))),
        F.lit(False),
    )


def framework(html: Column) -> Column:
    """Framework of a page source; "unknown" for a bare application root, else null."""
    return first_match(html, FRAMEWORKS, F.when(html.rlike(APP_ROOT), "unknown"))


def site_framework(html: Column, text: Column) -> Column:
    """Framework of a site's page; "unknown" where the text has under 500 characters."""
    return first_match(html, SITE_FRAMEWORKS, F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 500, "unknown"))


def lazy_marks(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"<img[^>]*(loading=\"lazy\"|data-src|data-lazy)|class=\"[^\"]*lazy"))


def endless_scroll(html: Column) -> Column:
    return html.rlike(r"class=\"[^\"]*(infinite|load-more)|data-infinite")


def shown_enough(word_count: Column, has_main: Column, headings: Column) -> Column:
    """Whether a page has come up: over 50 words, a main element, or over 2 headings."""
    return F.coalesce(word_count > 50, F.lit(False)) | F.coalesce(has_main, F.lit(False)) | F.coalesce(headings > 2, F.lit(False))

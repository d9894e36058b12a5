"""Column functions over text and paths; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, equal to those of the service whose results are matched.
STOPWORDS = (
    "a an the and or but of in on at to for with about is are was were be been being am do does did have has had "
    "will would can could should shall may might must what which who whom whose when where why how this that these "
    "those it its not no so if then than too very s t you your we our they their i me my"
).split()
SYNONYMS = (
    "cancel cancelled cancelling cancellation cancellations reverse reversed reversing reversal reversals withdraw withdrawal withdrawals".split(),
    "dd direct-debit".split(),
)
TEST_MARKERS = "test tests testdata sandbox staging mock mocks fixture fixtures example examples sample samples dev".split()
STRONG_HEAD_MARKERS = "testdata mock mocks fixture fixtures".split()
WEAK_HEAD_MARKERS = "sandbox staging".split()
GENERATED_DIRS = (
    "node_modules bower_components vendor vendored third_party third-party generated dist build out target __pycache__ .venv venv coverage .next .nuxt pods deriveddata"
).split()
SPEC_DIRS = "adr adrs rfc rfcs decision decisions design-docs designdocs".split()
SPEC_PROSE_DIRS = "spec specs".split()
SPEC_NAMES = "spec specs rfc rfcs adr adrs decision decisions".split()
LINT_NAMES = "golangci eslint flake8 pylint rubocop".split()
PROSE_EXTENSIONS = "md markdown rst txt adoc".split()
CODE_EXTENSIONS = (
    "rs py ts tsx js jsx mjs cjs mts cts go java kt kts scala c h cc hh cpp hpp cxx hxx cs rb php swift m mm sh bash zsh fish ps1 sql r lua pl pm ex exs erl hrl hs ml mli clj cljs dart vue svelte ipynb html htm css scss less sass proto graphql gql"
).split()
CONFIG_EXTENSIONS = "yml yaml json jsonc json5 toml ini cfg conf config env properties xml csv tsv hcl tf tfvars nix".split()
CONFIG_NAMES = "dockerfile containerfile makefile gnumakefile justfile gemfile vagrantfile brewfile cmakelists".split()
RECORD_PATTERNS = (
    r"\battendees\b", r"\bagenda\b", r"\bmeeting notes\b", r"\bminutes of\b", r"\bretro\b", r"\bdecision log\b", r"\bdecision:", r"\badr-",
    r"\bstatus:\s*accepted\b", r"\bagreed\b", r"\bdecided\b", r"\bapproved\b", r"\*\*status:\*\*\s*(confirmed|accepted|approved)",
    r"(?m)^#{1,6}\s+decision\b", r"\brevisit triggers?\b", r"(?m)^#{1,6}\s+action items?\s*:?\s*$", r"(?m)^\*\*action items?:?\*\*:?\s*$",
)
#: What every match of the pattern of the same place holds.
RECORD_PARTS = (
    "attendees", "agenda", "meeting notes", "minutes of", "retro", "decision log", "decision:", "adr-", "status:", "agreed", "decided", "approved", "**status:**", "decision", "revisit trigger", "action item", "**action item",
)
SUMMARY_CHARS, FALLBACK_CHARS = 1200, 800
TAG_STOPWORDS = (
    "the and for with this that from have will would about which when where what their there been also "
    "into more than some such only other could should a an the and or but of in on at to for"
).split()

#: Letters with marks and what the full-text tokenizer folds them to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    """Lower case without diacritics, as the full-text tokenizer sees it."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def words(folded_text: Column) -> Column:
    return F.regexp_extract_all(folded_text, F.lit(r"[\p{L}\p{N}]+"), 0)


def tokens(text: Column) -> Column:
    return words(folded(F.coalesce(text, F.lit(""))))


def query_terms(question: str) -> list[str]:
    """Lower-case runs of letters, digits, _, section signs and hyphens of two bytes or more, without stopwords; repeats stay."""
    import regex

    found = regex.findall(r"[\p{L}\p{N}_§\-]+", question.lower())
    return [t for t in found if len(t.encode()) >= 2 and t not in STOPWORDS]


def terms_column(text: Column) -> Column:
    """query_terms as a column."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_§\-]+"), 0)
    return F.filter(found, lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOPWORDS))


def expanded(terms: list[str]) -> list[str]:
    """Terms with the other members of their synonym clusters behind them, each once."""
    extra = [w for cluster in SYNONYMS if set(cluster) & set(terms) for w in cluster]
    return list(dict.fromkeys([*terms, *extra]))


def marked(text: Column, markers: list[str]) -> Column:
    """Whether a run of letters and digits of text is one of the markers."""
    return F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(*[F.lit(m) for m in markers]))


def env_class(path: Column, head: Column) -> Column:
    """test or live: a marker in the path, one strong marker in the first 1024 characters, or both weak ones."""
    top = F.substring(F.coalesce(head, F.lit("")), 1, 1024)
    weak = reduce(lambda a, b: a & b, [marked(top, [m]) for m in WEAK_HEAD_MARKERS])
    return F.when(marked(path, TEST_MARKERS) | marked(top, STRONG_HEAD_MARKERS) | weak, "test").otherwise("live")


def authority_tier(path: Column) -> Column:
    """0 spec, 1 code, 2 configuration, 3 prose, 4 generated; generated wins, then spec, code, configuration."""
    parts = F.split(F.lower(path), r"[/\\]")
    base = F.element_at(parts, -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    words = F.split(base, r"[^\p{L}\p{N}]+")
    ext = F.when(base.contains("."), F.element_at(F.split(base, r"\."), -1)).otherwise("")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")

    def among(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    generated = (
        F.arrays_overlap(dirs, among(GENERATED_DIRS)) | F.arrays_overlap(words, among(["lint", "lints", "generated"]))
        | base.rlike("|".join(LINT_NAMES)) | base.rlike(r"\.min\.|\.bundle\.|\.lock$|-lock\.")
    )
    spec = (
        F.arrays_overlap(dirs, among(SPEC_DIRS)) | base.rlike("^(adr|rfc)[-_]")
        | (ext.isin(PROSE_EXTENSIONS) & (F.arrays_overlap(dirs, among(SPEC_PROSE_DIRS)) | F.arrays_overlap(words, among(SPEC_NAMES))))
    )
    config = ext.isin(CONFIG_EXTENSIONS) | stem.isin(CONFIG_NAMES)
    return F.when(generated, 4).when(spec, 0).when(ext.isin(CODE_EXTENSIONS), 1).when(config, 2).otherwise(3)


def bucket(text: Column) -> Column:
    """record if a record pattern is in the lower-cased first 12000 characters, else reference."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 12_000))
    # made once per text; a pattern is tried where what it cannot do without is there
    found = F.exists(F.array(head), lambda h: reduce(lambda a, b: a | b, [h.contains(w) & h.rlike(p) for p, w in zip(RECORD_PATTERNS, RECORD_PARTS, strict=True)]))
    return F.when(found, "record").otherwise("reference")


def dot(x: Column, y: Column) -> Column:
    """In doubles."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 when empty, of different width or of zero norm."""
    size = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(fits, dot(a, b) / size).otherwise(0.0)


def half_away(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def is_page_number(line: Column) -> Column:
    """Lines like 42, Page 3, 3 of 10 or - 12 -."""
    return line.rlike(r"(?i)^(?:page\s*)?\d{1,4}(?:\s*of\s*\d{1,4})?\s*$") | line.rlike(r"^[-–—]\s*\d{1,4}\s*[-–—]$")


def repeat_key(line: Column) -> Column:
    """Trimmed, inner white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def html_to_text(html: Column) -> Column:
    """Scripts and styles out, headings as #, blocks as lines, cells as tabs, entities decoded, white space tidied."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{n}[^>]*>", "\n" + "#" * n + " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|tr|table|section|article|header|footer|nav|h[1-6])[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</t[dh]>", "\t")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \x0B\f\r]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def snippet(text: Column, terms: list[str], width: int) -> Column:
    """width characters around the earliest term, with ellipses where it is cut; the head if no term occurs."""
    lower = F.lower(text)
    size = F.length(text)
    first, span = F.lit(None).cast("int"), F.lit(0)
    for t in terms:
        at = F.when(F.instr(lower, t) > 0, F.instr(lower, t) - 1)
        better = at.isNotNull() & (first.isNull() | (at < first))
        first, span = F.when(better, at).otherwise(first), F.when(better, F.lit(len(t))).otherwise(span)
    half = F.floor(F.greatest(F.lit(0), F.lit(width) - span) / 2)
    end = F.least(F.greatest(F.lit(0), first - half) + width, size)
    start = F.when(first.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), end - width)).cast("int")
    cut = F.substring(text, start + 1, F.lit(width))
    left = F.when(start > 0, "…").otherwise("")
    right = F.when(first.isNotNull() & (start + width < size), "…").otherwise("")
    return F.when(size <= width, text).otherwise(F.concat(left, cut, right))


def _trimmed(text: Column, n: int) -> Column:
    return F.regexp_replace(F.substring(text, 1, n), r"^\s+|\s+$", "")


def section_summary(text: Column) -> Column:
    """The first two paragraphs, trimmed, at most 1200 characters; where they are blank the first 800 of the text."""
    two = F.regexp_replace(F.array_join(F.slice(F.split(text, "\n\n"), 1, 2), "\n\n"), r"^\s+|\s+$", "")
    return F.when(two == "", _trimmed(text, FALLBACK_CHARS)).otherwise(_trimmed(two, SUMMARY_CHARS))


def document_summary(text: Column) -> Column:
    """The head of the trimmed text, at most 1200 characters."""
    return _trimmed(F.regexp_replace(text, r"^\s+", ""), SUMMARY_CHARS)


def page_crumb(first: Column, last: Column) -> Column:
    """(p. N) or (pp. A-B); null without pages."""
    a, b = first.cast("string"), last.cast("string")
    return F.when(first == last, F.concat(F.lit("(p. "), a, F.lit(")"))).when(first.isNotNull() & last.isNotNull(), F.concat(F.lit("(pp. "), a, F.lit("-"), b, F.lit(")")))

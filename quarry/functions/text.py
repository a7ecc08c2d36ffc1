"""Text normalisation column functions.

Everything except ``html_to_text`` is a native Catalyst expression. HTML to
text needs a real HTML tokenizer (script bodies may contain ``"</p>"``,
entities must be decoded), so it is an Arrow UDF around the standard-library
parser: one small per-value helper, Spark does the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.slices import text_slices, trim

# Character classes of the two normalisers and the sentence boundary.
NON_PRINTABLE_ASCII = "[^\\x20-\\x7E\\t\\n\\r\\x0B\\x0C]"
CONTROL_CHARS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"
SENTENCE_END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s"
SENTENCE_BOUNDARY = "(?U)" + SENTENCE_END  # words and blanks of all alphabets in Java too
ISO_DATE = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?"
            r"(Z|[+-]\d{2}(:?\d{2})?)?$")
SKIP_TAGS = {"script", "style", "template"}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


class _TextExtractor(HTMLParser):
    """Text nodes in document order; script/style/template bodies, comments,
    doctype and processing instructions are not text. Entities are decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in SKIP_TAGS and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text_py(s: str | None) -> str | None:
    if s is None:
        return None
    p = _TextExtractor()
    p.feed(s)
    p.close()
    return "".join(p.parts)


def _html_to_text_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Slices go back as they are parsed, so a worker never holds the texts of a batch twice."""
    try:
        for texts in batches:
            for a, b in text_slices(texts):
                yield pa.array([html_text_py(t) for t in texts[a:b].to_pylist()], pa.string())
    finally:
        trim()


def _without(drop: str):
    """The same, less a class of characters."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _html_to_text_batches(batches):
            yield pc.replace_substring_regex(texts, drop, "")

    return run


# Marked non-deterministic so Catalyst neither duplicates the call into pushed-down
# filters nor moves it below a repartition: the parse runs once, after ``spread``.
_html_to_text, _html_to_ascii, _html_to_stripped = (
    F.arrow_udf(f, T.StringType()).asNondeterministic() for f in (_html_to_text_batches, _without(NON_PRINTABLE_ASCII), _without(CONTROL_CHARS)))


def html_to_text(c) -> Column:
    """H4."""
    return _html_to_text(_c(c))


def printable_ascii(c) -> Column:
    """H5: keep ``string.printable`` characters only (articles)."""
    return F.regexp_replace(_c(c), NON_PRINTABLE_ASCII, "")


def html_to_printable_ascii(c) -> Column:
    """H4, H5 in one: ``printable_ascii(html_to_text(c))``, whose regex the optimizer would copy into
    every filter on the text; what comes out of the parser is read as it is."""
    return _html_to_ascii(_c(c))


def html_to_stripped(c) -> Column:
    """H4, H6 in one: ``strip_control(html_to_text(c))``, likewise."""
    return _html_to_stripped(_c(c))


def strip_control(c) -> Column:
    """H6: drop C0/C1 control characters except tab, LF, CR; keep Unicode (trees)."""
    return F.regexp_replace(_c(c), CONTROL_CHARS, "")


def normalize_date(c) -> Column:
    """H7: ISO-8601 text -> UTC ISO text with ``+00:00`` offset, fraction only when
    non-zero; anything unparsable -> NULL. Naive values are taken as UTC."""
    s = _c(c)
    ts = F.when(s.rlike(ISO_DATE), F.try_to_timestamp(s))
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNotNull(), F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
        F.lit("+00:00")))


def csv_or_empty(c) -> Column:
    """H8: ``s.split(',')`` when non-empty, else ``[]``; no trimming."""
    s = _c(c)
    return F.when(F.length(s) > 0, F.split(s, ",")).otherwise(F.array().cast("array<string>"))


def flag(c) -> Column:
    """H9: ``bool(int(x))``."""
    return _c(c).try_cast("int") != 0  # invalid text gives NULL instead of failing the job


def details_text(details) -> Column:
    """Non-empty ``value`` fields joined by newline."""
    d = _c(details)
    return F.array_join(F.transform(F.filter(d, lambda x: F.length(x["value"]) > 0), lambda x: x["value"]), "\n")


def context_string(title, description, mode: str | None) -> Column:
    """Title and description (non-empty ones) joined by a space, prefix/suffix only."""
    if mode not in ("prefix", "suffix"):
        return F.lit("")
    parts = F.filter(F.array(_c(title), _c(description)), lambda x: F.length(x) > 0)
    return F.array_join(parts, " ")


def chunk_text(snippet, ctx, mode: str | None) -> Column:
    """Prefix ``ctx snippet`` / suffix ``snippet ctx`` (space kept even when ctx is
    empty) / snippet."""
    if mode == "prefix":
        return F.concat(_c(ctx), F.lit(" "), _c(snippet))
    if mode == "suffix":
        return F.concat(_c(snippet), F.lit(" "), _c(ctx))
    return _c(snippet)


def fixed_split(text, n) -> Column:
    """Consecutive slices of ``n`` characters (code points); ``[]`` for empty text.

    One left-to-right regex scan (``(?s).{1,n}``), linear in the text length;
    slicing with ``substring`` per piece would rescan from the start each time."""
    t = _c(text)
    n = n if isinstance(n, Column) else F.lit(n)
    pattern = F.concat(F.lit("(?s).{1,"), n.cast("string"), F.lit("}"))
    return F.when(F.length(t) > 0, F.regexp_extract_all(t, pattern, F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def split_sentences(text) -> Column:
    """H15."""
    return F.split(_c(text), SENTENCE_BOUNDARY, -1)


def char_length(c) -> Column:
    """Code points, like Python ``len``."""
    return F.length(_c(c))


def render_template(template, **values) -> Column:
    """Replace ``{{name}}`` placeholders with column values."""
    out = _c(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(_c(v), F.lit("")))
    return out

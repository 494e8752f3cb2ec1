"""Text expressions: cleaning, artifacts, languages, keywords, keys and values.

All are built from JVM-side functions, so they run inside generated code.  Null
texts behave like empty ones unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as fixed

#: Characters that count as white space at the ends of a text and between words.
_WS = r"[\s\x1c-\x1f]"
_ANY_CASE = "(?iud)"
#: The same characters one by one.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: All characters beyond ASCII that equal one of its letters (i, k, s) where case doesn't count.
_FOLDED = "\u0130\u0131\u017f\u212a"


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def clean_text(text: Column) -> Column:
    """Recognised text without control and replacement characters, with single spaces and no empty lines.

    Question marks go too.  Tabs become spaces after runs of spaces have been
    folded, so a tab between spaces leaves several.
    """
    out = F.regexp_replace(_or_empty(text), r"[?\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFD]", "")
    for pattern, by in ((r"•{4,}", ""), (r" {2,}", " "), (r"\t+", " "), (r"\n{3,}", "\n")):
        out = F.regexp_replace(out, pattern, by)
    lines = F.filter(F.transform(F.split(out, "\n", -1), strip), lambda line: line != "")
    return F.array_join(lines, "\n")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def needed_literals(pattern: str) -> list[tuple[str, ...]]:
    """What a text must hold, in lower case, for the pattern to match: one literal of each tuple, the longest first."""

    def walk(tree: parser.SubPattern) -> list[tuple[str, ...]]:
        found, run = [], ""
        for op, value in tree:
            if op is ops.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            found, run = found + [(run,)], ""
            if op is ops.SUBPATTERN:
                found += walk(value[-1])
            elif op is ops.MAX_REPEAT and value[0] > 0:
                found += walk(value[2])
            elif op is ops.BRANCH:
                each = [walk(branch) for branch in value[1]]
                found += [tuple(x for terms in each for x in terms[0])] if all(each) else []
        return sorted({t for t in [*found, (run,)] if all(t)}, key=lambda t: (-min(map(len, t)), t))

    return walk(parser.parse(pattern))


def _may_match(text: Column, patterns: Sequence[str]) -> Column:
    """Whether the text holds the literals of any of the patterns: a search for words, far cheaper than theirs."""

    def found(low: Column) -> Column:
        some = [F.contains(text, F.lit(c)) for c in _FOLDED]
        for p in patterns:
            terms = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in t]) for t in needed_literals(p)]
            some.append(reduce(lambda a, b: a & b, terms) if terms else F.lit(True))
        return reduce(lambda a, b: a | b, some)

    return _let(F.lower(text), found)


def _cut(text: Column, patterns: Sequence[str]) -> Column:
    """The text without what the patterns match, one after the other.

    Most texts hold none of their literals and stay as they are.  In the others
    a pattern is tried if the signs it needs, which have no case, are still there.
    """

    def step(out: Column, pattern: str) -> Column:
        signs = sorted({c for t in needed_literals(pattern) if len(t) == 1 for c in t[0] if not c.isalnum() and c != " "})
        by = lambda t: F.regexp_replace(t, _ANY_CASE + pattern, "")
        return _let(out, lambda t: F.when(reduce(lambda a, b: a & b, [F.contains(t, F.lit(c)) for c in signs]), by(t)).otherwise(t)) if signs else by(out)

    return _let(text, lambda t: F.when(_may_match(t, patterns), reduce(step, patterns, t)).otherwise(t))


def artifact_patterns(mode: str = "compat") -> list[str]:
    """Patterns cut out of texts.

    ``compat`` takes doubled backslashes literally, so most patterns ask for a
    backslash in the text and paths end at the letter s; ``intended`` reads them
    as the escapes they were meant to be.
    """
    if mode == "compat":
        return list(fixed.TEXT_ARTIFACTS)
    if mode == "intended":
        return [r"[A-Za-z]:\\[^\s]+" if p.startswith(r"[A-Za-z]:\\") else p.replace("\\\\", "\\") for p in fixed.TEXT_ARTIFACTS]
    raise ValueError(f"unknown mode {mode!r}")


def filter_artifacts(text: Column, mode: str = "compat") -> Column:
    """The text without artifacts, stripped; null stays null."""
    return strip(_cut(text, artifact_patterns(mode)))


def letter_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text)


def filter_for_confidence(text: Column, mode: str = "compat") -> Column:
    """Artifacts out, then lines with too few letters or short ones of signs alone.

    In ``compat`` mode a line ends at a backslash followed by n, so an ordinary
    text is a single line.
    """
    cut, join, noise = (r"\\n", "\\n", r"^[\\d\\s\\W]+$") if mode == "compat" else ("\n", "\n", r"(?U)^[\d\s\W]+$")
    lines = F.transform(F.split(filter_artifacts(text, mode), cut, -1), strip)
    good = F.filter(lines, lambda x: (x != "") & ~(letter_share(x) < 0.3) & ~(x.rlike(noise) & (F.length(x) < 10)))
    return F.when(text.isNull() | (text == ""), text).otherwise(F.array_join(good, join))


def has_artifacts(text: Column, mode: str = "compat") -> Column:
    return reduce(lambda a, b: a | b, [_or_empty(text).rlike(_ANY_CASE + p) for p in artifact_patterns(mode)])


def artifact_types(text: Column) -> Column:
    """Names of the kinds of artifacts in the text, in a fixed order."""
    found = [F.when(_or_empty(text).rlike(("" if case else _ANY_CASE) + p), F.lit(name)) for name, p, case in fixed.ARTIFACT_KINDS]
    return F.array_compact(F.array(*found))


def is_box_artifact(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [_or_empty(text).rlike(_ANY_CASE + p) for p in fixed.BOX_ARTIFACTS])


def count_hits(low: Column, words: Sequence[str]) -> Column:
    """How many of the words a lower-case text contains, unrolled so that it stays in generated code."""
    if not words:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w.lower())).cast("int") for w in words])


def any_hit(low: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])


def hits(low: Column, words: Sequence[str]) -> Column:
    """The words, as given, that a lower-case text contains."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words]))


def without_box_artifacts(text: Column) -> Column:
    return strip(_cut(_or_empty(text), fixed.BOX_ARTIFACTS))


def detect_language(text: Column, languages: Mapping[str, Sequence[str]] = fixed.LANGUAGE_KEYWORDS, primary: str = fixed.PRIMARY_LANGUAGE) -> Column:
    """The language with the most keywords in the text; the first of equals; ``primary`` if none has any.

    Artifacts are taken out first.  Empty texts are in ``primary``.
    """
    def best(low: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("order"), F.lit(primary).alias("lang"))
        scores = [F.struct(count_hits(low, words).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("lang")) for i, (name, words) in enumerate(languages.items())]
        return F.array_max(F.array(none, *scores)).lang if scores else F.lit(primary)

    return _let(F.lower(without_box_artifacts(text)), best)


def language_of(text: str, languages: Mapping[str, Sequence[str]] = fixed.LANGUAGE_KEYWORDS, primary: str = fixed.PRIMARY_LANGUAGE) -> str:
    """What ``detect_language`` says of one text, for use between two steps of reading a page."""
    for p in fixed.BOX_ARTIFACTS:
        text = re.sub(p, "", text, flags=re.IGNORECASE)
    low, best, found = text.lower(), 0, primary
    for name, words in languages.items():
        n = sum(w.lower() in low for w in words)
        if n > best:
            best, found = n, name
    return found


def key_values_json(text: Column) -> Column:
    """The keys and values of a text as a JSON object, in line order."""
    return F.to_json(F.map_from_entries(key_values(text)))


def key_values(text: Column) -> Column:
    """Array of (``key``, ``value``), in line order, of lines ``key: value`` or, failing a colon, ``key - value``.

    Of equal keys the last value counts.  If no line has either form, each line
    that isn't blank is the value of ``line_n``.
    """
    lines = F.split(_or_empty(text), "\n", -1)

    def pair(line: Column, sign: str) -> Column:
        at = F.instr(line, sign)
        parts = F.struct(strip(F.substring(line, F.lit(1), at - 1)).alias("key"), strip(F.substring(line, at + 1, F.length(line))).alias("value"))
        return F.when((at > 1) & (F.length(line) > at), parts)

    pairs = F.array_compact(F.transform(lines, lambda line: F.coalesce(pair(line, ":"), pair(line, "-"))))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.key == p.key))
    numbered = F.transform(lines, lambda line, i: F.struct(F.concat(F.lit("line_"), (i + 1).cast("string")).alias("key"), strip(line).alias("value")))
    return F.when(F.size(pairs) > 0, last).otherwise(F.filter(numbered, lambda p: p.value != ""))


def word_count(text: Column) -> Column:
    bare = strip(_or_empty(text))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, rf"(?U){_WS}+", -1)))


def text_length(text: Column) -> Column:
    return F.length(_or_empty(text))


def angle_count(text: Column) -> Column:
    """Number of ``<`` signs, which fill machine-readable zones."""
    return F.length(_or_empty(text)) - F.length(F.replace(_or_empty(text), F.lit("<"), F.lit("")))


def page_prefix(key: Column) -> Column:
    return F.split_part(key.cast("string"), F.lit("-"), F.lit(1))


def html_fragment(text: Column, page: Column) -> Column:
    body = F.replace(_or_empty(text), F.lit("\n"), F.lit("<br>"))
    return F.concat(F.lit("<h3>Page "), page.cast("string"), F.lit("</h3><div>"), body, F.lit("</div>"))


def html_escape(text: Column) -> Column:
    """Escaped for HTML; an empty text says that there is none."""
    out = _or_empty(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.when(_or_empty(text) == "", "(No text detected)").otherwise(out)


def preview(text: Column, size: int = 40) -> Column:
    """The beginning of the text on one line."""
    short = F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
    return F.when(_or_empty(text) == "", "(No text)").otherwise(F.translate(short, "\n\r", " "))

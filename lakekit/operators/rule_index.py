"""An index over many pattern rules, so that a line is only searched by those that can match it.

Whatever a pattern matches holds certain literal pieces, and a path that a glob selects ends in certain folders. Such
pieces become keys of the rules. Lines and paths give the keys they hold, and rows and rules meet by an equi-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 4

# Where a pattern's literal text breaks off, and where its escaped metacharacters wait: code points no pattern may hold.
_BREAK = "\x00"
_METACHARACTERS = ".^$*+?()[]{}|\\"
_WAITING = "".join(chr(0xF700 + i) for i in range(len(_METACHARACTERS)))

_OPENING = r"\((?:\?(?:[:>]|<[A-Za-z]\w*>))?"
_MAY_MISS = r"(?:[?*][?+]?|\{0(?:,[0-9]*)?\}[?+]?)"
_REPEATED = r"(?:\+[?+]?|\{[1-9][0-9]*(?:,[0-9]*)?\}[?+]?)"
# An escape that stands for a class, a position, a reference or a character by number.
_ESCAPE = r"\\(?:x[0-9a-fA-F]{2}|x\{[^}]*\}|u[0-9a-fA-F]{4}|[pP]\{[^}]*\}|[pP].|k<[^>]*>|N\{[^}]*\}|c.|0?[0-9]{1,3}|.)"
_CLASS = r"\[\^?\]?(?:[^\[\]]|\[[^\]]*\])*\]"
_DEPTH = 6

# From the inside out: what may be missing, looks around or is one of several is no required text; other groups are
# opened. Each entry is a pattern and what takes its place. A quantifier is no character that another one follows.
_STEPS = [
    (rf"{_BREAK}(?:{_MAY_MISS}|{_REPEATED})", _BREAK),
    (rf"[^()|?*+{_BREAK}]{_MAY_MISS}", _BREAK),
    (rf"([^()|?*+{_BREAK}]){_REPEATED}", rf"$1{_BREAK}"),
    (rf"\(\?<?[=!][^()]*\)(?:{_MAY_MISS}|{_REPEATED})?", _BREAK),
    (rf"{_OPENING}[^()]*\){_MAY_MISS}", _BREAK),
    (rf"{_OPENING}[^()]*\|[^()]*\)(?:{_REPEATED})?", _BREAK),
    (rf"{_OPENING}([^()|]*)\){_REPEATED}", rf"$1{_BREAK}"),
    (rf"{_OPENING}([^()|]*)\)(?![?*+{{])", "$1"),
]


def required_pieces(pattern: Column) -> Column:
    """Literal texts of which each match of a pattern holds one: the longest of each alternative; null if none is known.

    An alternative whose longest literal is shorter than an index key makes the whole unknown, and so does what this
    reading does not cover: quoting, inline flags other than ``s``, ``m``, ``u`` and ``U``, and groups nested deeply.
    """
    flags = r"^\(\?[smuU]+\)"
    odd = rf"[{_BREAK}{_WAITING}]|\\[QE]|\(\?[A-Za-z-]+[:)]|\(\?[#]"
    plain = F.regexp_replace(pattern, flags, "")
    known = F.when(~F.rlike(plain, F.lit(odd)), plain)
    # Pairs of backslashes go first, so that each one left begins an escape.
    waiting = F.replace(known, F.lit("\\\\"), F.lit(_WAITING[-1]))
    for shown, held in zip(_METACHARACTERS[:-1], _WAITING):
        waiting = F.replace(waiting, F.lit("\\" + shown), F.lit(held))
    text = F.regexp_replace(waiting, r"\\([^A-Za-z0-9])", "$1")
    text = F.regexp_replace(F.regexp_replace(text, _ESCAPE, _BREAK), _CLASS, _BREAK)
    text = F.regexp_replace(text, r"[.^$]", _BREAK)
    for _ in range(_DEPTH):
        text = reduce(lambda done, step: F.regexp_replace(done, *step), _STEPS, text)
    alternatives = F.split(F.when(~F.rlike(text, F.lit(r"[()\[\]{}*+?]")), text), r"\|", -1)
    longest = F.transform(alternatives, lambda alternative: _longest(F.split(alternative, rf"{_BREAK}+", -1)))
    pieces = F.transform(longest, lambda piece: F.translate(piece, _WAITING, _METACHARACTERS))
    return F.when(F.forall(pieces, lambda piece: F.char_length(piece) >= GRAM), pieces)


def _longest(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(""), lambda best, text: F.when(F.char_length(text) > F.char_length(best), text).otherwise(best))


def grams(text: Column) -> Column:
    """The distinct pieces of a fixed length of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), 1))


def fixed_folder(glob: Column) -> Column:
    """The folders that a path a glob selects must end in, up to the last slash; null if these are not fixed."""
    plain = F.regexp_replace(F.translate(glob, "\\", "/"), "^[./]+", "")
    folder = F.regexp_extract(plain, r"(?s)^(.*/)[^/]*$", 1)
    return F.when((folder != "") & ~F.rlike(folder, F.lit("[*?]")) & ~F.contains(plain, F.lit("**")), folder)


def _whole(parts: Column) -> Column:
    """An array without nulls and with entries, or null."""
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda part: part.isNotNull()), parts)


def rule_index(rules: DataFrame) -> DataFrame:
    """``rule_no, kind, key`` of rules with ``rule_no, pattern, file_paths, path_regexes``.

    A rule can only apply to a row that holds one of its keys. There are three kinds: the fixed folders of its globs
    (``folder``), pieces of its pattern (``line``) and pieces of its globs (``path``). Of the pieces of a literal, the
    one that fewest rules share is the key, and each rule has the kind whose keys fewest share. Rules without any key
    are left out.
    """
    paths = F.transform("path_regexes", required_pieces)
    options = rules.select(
        "rule_no",
        F.array(
            F.struct(F.lit("folder").alias("kind"), _whole(F.transform("file_paths", fixed_folder)).alias("texts")),
            F.struct(F.lit("line").alias("kind"), _whole(required_pieces(F.col("pattern"))).alias("texts")),
            F.struct(F.lit("path").alias("kind"), _whole(F.flatten(_whole(paths))).alias("texts")),
        ).alias("_options"),
    ).select("rule_no", F.inline("_options"))
    texts = options.select("rule_no", "kind", F.posexplode("texts").alias("text_no", "text"))
    keys = texts.select(
        "rule_no",
        "kind",
        "text_no",
        F.explode(F.when(F.col("kind") == "folder", F.array("text")).otherwise(grams(F.col("text")))).alias("key"),
    )
    sharing = keys.groupBy("kind", "key").agg(F.count_distinct("rule_no").alias("n"))
    best = F.min(F.struct("n", "key")).alias("best")
    chosen = keys.join(sharing, ["kind", "key"]).groupBy("rule_no", "kind", "text_no").agg(best)
    shared = F.max("best.n").over(Window.partitionBy("rule_no", "kind"))
    ranked = chosen.select("rule_no", F.struct(shared.alias("n"), "kind").alias("by"), F.col("best.key").alias("key"))
    least = F.min("by").over(Window.partitionBy("rule_no"))
    kept = ranked.withColumn("_least", least).filter(F.col("by") == F.col("_least"))
    return kept.select("rule_no", F.col("by.kind").alias("kind"), "key").distinct()


def row_keys(kinds: list[str], folder_lengths: list[int], line: Column, path: Column) -> Column:
    """The keys a row holds, as an array of ``kind, key``; ``folder_lengths`` are the lengths that folder keys have."""

    def of(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key")))

    folder = F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1)
    lengths = F.array(*[F.lit(n) for n in folder_lengths]).cast("array<int>")
    ends = F.transform(F.filter(lengths, lambda n: n <= F.char_length(folder)), lambda n: F.right(folder, n))
    found = {"folder": ends, "line": grams(line), "path": grams(path)}
    return F.concat(*[of(kind, found[kind]) for kind in kinds])

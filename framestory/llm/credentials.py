"""Secret scan: trigram inverted index, Boolean queries derived from the rules, exact verification."""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestory.llm.common import same, strings, text_rows


@dataclass(frozen=True)
class SecretRule:
    """One kind of secret: ``pattern`` in the syntax that Java, RE2 and Python share."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The three base rules, then rules of this library's own.
RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    SecretRule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    SecretRule("camera_url", r"[a-z][a-z0-9+.-]{1,9}://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%-]+@"),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

MOST_STRINGS = 64


def _exact(parsed) -> tuple[set[str] | None, list[set[str]]]:
    """What a parsed pattern must contain.

    Returns the finite set of strings it equals (None if there is no such set)
    and the groups of literals of which each match holds at least one.
    """
    runs: list[set[str]] = [{""}]
    needed: list[set[str]] = []
    whole = True

    def cut():
        nonlocal whole
        needed.append(runs[0])
        runs[0], whole = {""}, False

    for op, arg in parsed:
        name, options = str(op), None
        if name == "LITERAL":
            options = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            options = {chr(v) for _, v in arg}
        elif name == "SUBPATTERN":
            options, inner = _exact(arg[3])
            needed += inner if options is None else []
        elif name == "BRANCH":
            parts = [_exact(p)[0] for p in arg[1]]
            options = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT":
            lo, hi, sub = arg
            one, inner = _exact(sub)
            if one is not None and (lo, hi) == (0, 1):
                options = one | {""}
            elif one is not None and lo == hi and len(one) ** lo <= MOST_STRINGS:
                options = {""}
                for _ in range(lo):
                    options = {a + b for a in options for b in one}
            elif lo:
                needed += inner
        if options is None or len(runs[0]) * len(options) > MOST_STRINGS:
            cut()
        else:
            runs[0] = {a + b for a in runs[0] for b in options}
    needed.append(runs[0])
    return (runs[0] if whole else None), needed


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The pattern's Boolean trigram query as alternatives of trigram sets; None if nothing is mandatory.

    Of the literal groups a match must contain, the one whose shortest literal
    is longest is taken.  Trigrams are ASCII lower case, as the index is.
    """
    _, needed = _exact(regex_parser.parse(pattern))
    best = max(needed, key=lambda g: min(map(len, g)), default={""})
    if min(map(len, best)) < 3:
        return None
    return sorted({frozenset(s.lower()[i:i + 3] for i in range(len(s) - 2)) for s in best}, key=sorted)


def trigram_postings(records: DataFrame, trigrams: list[str], key: str = "failure_id", text: str = "description") -> DataFrame:
    """Inverted index ``(trigram, key)`` over the trigrams that some rule asks for."""
    low = text_rows(records, key, text).select("_id", F.lower("_text").alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(found).alias("trigram"), F.col("_id").alias(key))


def candidates(spark: SparkSession, postings: DataFrame, rules=RULES, key: str = "failure_id") -> DataFrame:
    """Per key the kinds (array ``kinds``) whose Boolean query its postings satisfy.

    Posting lists are intersected by key: an alternative holds where all of its
    trigrams were counted, so a trigram that most texts hold is no hot group.
    """
    terms = [(r.kind, b, t, len(alt)) for r in rules for b, alt in enumerate(trigram_query(r.pattern) or []) for t in sorted(alt)]
    wanted = spark.createDataFrame(terms, "kind string, branch int, trigram string, need int")
    full = (postings.distinct().join(wanted, "trigram").groupBy(key, "kind", "branch")
            .agg(F.count(F.lit(1)).alias("_n"), F.first("need").alias("_need")).where("_n >= _need"))
    return full.groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: SecretRule) -> Column:
    """Spans (start, end in code points) of the rule's leftmost non-overlapping matches that are long enough.

    The text between matches and the matches alternate, so their lengths add up to positions.
    """
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, z):
        begin = acc["at"] + F.length(z["gap"])
        end = begin + F.length(z["hit"])
        value = F.regexp_extract(z["hit"], rule.pattern, rule.group) if rule.group else z["hit"]
        new = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        out = F.when(F.length(value) >= rule.least, F.concat(acc["out"], new)).otherwise(acc["out"])
        return F.when(z["hit"].isNull(), acc).otherwise(F.struct(end.cast("int").alias("at"), out.alias("out")))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def scan_secrets(failures: DataFrame, key: str = "failure_id", text: str = "description", rules=RULES) -> DataFrame:
    """Secrets in the free text of failure records (or of any log), one row per record.

    A record's text is scanned whole.  Rules with mandatory trigrams are looked
    up in the inverted index and verified on the candidates; rules without (a
    hexadecimal run) scan every text.  Returns ``key`` and one array of
    (start, end) per rule, in code points, end exclusive, named by its kind.

    Null or empty text has no spans; null keys and repeated rows are kept, a row
    each; other columns don't pass; an empty table gives an empty result.
    """
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in asked.values() if q for alt in q for t in alt})
    d = text_rows(failures, key, text)
    if trigrams:
        c = candidates(failures.sparkSession, trigram_postings(failures, trigrams, key, text), rules, key).withColumnRenamed(key, "_key")
        d = d.join(c, same(d, c, [("_id", "_key")]), "left").drop("_key")
    else:
        d = d.withColumn("kinds", strings([]))
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = {r.kind: _spans(F.col("_text"), r) if asked[r.kind] is None
             else F.when(F.array_contains("kinds", r.kind), _spans(F.col("_text"), r)).otherwise(none) for r in rules}
    return d.select(F.col("_id").alias(key), *[F.coalesce(e, none).alias(k) for k, e in found.items()])


def span_list(kinds: list[str]) -> Column:
    """``kind:start:end`` of the named kinds' spans by start, then in the kinds' order, comma-joined."""
    def named(i: int, k: str) -> Column:
        return F.transform(F.col(k), lambda s: F.struct(s["start"], F.lit(i).alias("kind"), s["end"]))

    every = F.concat(*[named(i, k) for i, k in enumerate(kinds)])
    name = strings(kinds)
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")

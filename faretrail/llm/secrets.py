"""Operator 1: secret scans through a trigram index, in DataFrame functions only.

From each rule's expression the trigrams that any match must hold are derived,
as alternatives of conjunctions. The index has a posting (trigram, document)
for those trigrams that some rule asks for. Postings are intersected by
grouping; only the documents that satisfy a rule's query are searched for it.
A rule without mandatory trigrams is searched in every document.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretrail.llm.common import fresh_name


class Rule(NamedTuple):
    kind: str
    pattern: str  # the same in Java's and Python's syntax
    value: int = 0  # group that the least length holds for
    least: int = 1


#: The base rules, in the order of the contract.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Rules beyond the base: tokens and key blocks with a fixed beginning.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Alternatives beyond which a part of an expression counts as anything.
MOST = 64
#: A character class of at most so many characters is taken apart.
SMALL_CLASS = 8


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams that every match holds; none if some match needs none.

    An expression is read as alternatives of literal runs: a class of many
    characters or a repetition ends a run, an optional part gives an alternative
    with and one without it.
    """
    alternatives = _runs(re._parser.parse(pattern))
    out = {frozenset(r[i: i + 3].lower() for r in runs for i in range(len(r) - 2)) for runs in alternatives}
    # an alternative that asks for more than another adds nothing to it
    least = [c for c in out if not any(d < c for d in out)]
    return [] if frozenset() in out else sorted(least, key=sorted)


def _joined(left: list[tuple[str, ...]], right: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Every left followed by every right; the runs at the seam become one."""
    if len(left) * len(right) > MOST:
        return [(*x, "", "") for x in left]
    return list(dict.fromkeys((*a[:-1], a[-1] + b[0], *b[1:]) for a in left for b in right))


def _runs(nodes) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [("",)]
    for kind, value in nodes:
        name, gap = str(kind), [("", "")]
        if name == "LITERAL":
            part = [(chr(value),)]
        elif name == "IN":
            chars = [chr(v) for k, v in value if str(k) == "LITERAL"]
            part = [(c,) for c in chars] if len(chars) == len(value) <= SMALL_CLASS else gap
        elif name == "SUBPATTERN":
            part = _runs(value[-1])
        elif name == "BRANCH":
            part = [x for branch in value[1] for x in _runs(branch)]
        elif name == "MAX_REPEAT":
            least, most, inner = value
            if (least, most) == (0, 1):
                part = [("",), *_runs(inner)]
            elif least == 0:
                part = gap
            else:
                part = _joined(_joined(_runs(inner), [("", "")]), [("",)])
        elif name == "AT":
            part = [("",)]
        else:
            part = gap
        out = _joined(out, part)
    return out


def _posting_lists(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The index: a row for each document and each trigram of it that a rule asks for."""
    wanted = sorted({g for r in rules for conjunction in trigram_query(r.pattern) for g in conjunction})
    low = docs.select(F.col(key), F.lower(text).alias("low"))
    held = F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(F.col("low"), g))
    return low.select(key, F.explode(held).alias("gram"))


def _candidates(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame | None:
    """``(key, rules)``: the rules whose trigram query a document satisfies."""
    asked = [(r.kind, c, g, 1 << i, (1 << len(q)) - 1) for r in rules
             for c, q in enumerate(trigram_query(r.pattern)) for i, g in enumerate(sorted(q))]
    if not asked:
        return None
    spark = docs.sparkSession
    asked = spark.createDataFrame(asked, "kind string, conjunction int, gram string, bit long, full long")
    # the rules' trigrams are a fixed short list
    met = _posting_lists(docs, key, text, rules).join(F.broadcast(asked), "gram")
    met = met.groupBy(key, "kind", "conjunction", "full").agg(F.bit_or("bit").alias("bits")).where("bits = full")
    return met.groupBy(key).agg(F.collect_set("kind").alias("rules"))


def _once(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value of an expression, which is evaluated once: a lambda's variable is not merged into it as a column is."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _found(text: str, asked: str, rank: int, rule: Rule) -> Column:
    """Spans of a rule in a text as structs (start, rank, end), if the rule is ``asked`` for.

    Ends are prefix sums of the lengths of the matches and of the pieces between
    them, by doubling the summed distance: as many steps as the number of
    matches has binary digits. Each regular expression runs once a text, pieces
    and values only where there are matches.
    """
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    none = "CAST(array() AS array<string>)"
    sums = """aggregate(sequence(0, 30), transform(m, (x, i) -> bigint(char_length(p[i]) + char_length(x))),
        (acc, j) -> IF(shiftleft(1, j) >= size(acc), acc,
            transform(acc, (x, i) -> x + IF(i >= shiftleft(1, j), acc[i - shiftleft(1, j)], 0L))))"""
    spans = f"""transform({sums}, (e, i) -> named_struct('start', e - char_length(m[i]), 'rank', {rank}, 'end', e, 'ok', char_length({'v' if rule.value else 'm'}[i]) >= {rule.least}))"""
    spans = f"transform(filter({spans}, s -> s.ok), s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end))"
    if rule.value:
        spans = _once(f"regexp_extract_all({text}, '{pattern}', {rule.value})", "v", spans)
    spans = _once(f"split({text}, '{pattern}', -1)", "p", spans)
    empty = f"CAST(array() AS array<struct<start: bigint, rank: int, end: bigint>>)"
    matches = f"IF({asked}, regexp_extract_all({text}, '{pattern}', 0), {none})"
    return F.expr(_once(matches, "m", f"IF(size(m) = 0, {empty}, {spans})"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", doc: str | None = "doc_id") -> DataFrame:
    """Add ``secrets``: all rules' spans in a document's whole text.

    ``secrets`` is an array of (start, rank, end, kind), sorted, in code points,
    the end exclusive; a rule's matches are leftmost and do not overlap, and
    those whose value is shorter than the rule's least length are dropped.
    Null texts count as empty. Rows stay one to one, repeated ones too (rows
    with equal id and text share their postings, which is harmless as every
    candidate is searched anyway). A column of this name is replaced.
    """
    key, body, mine = (fresh_name(docs, x) for x in ("posting_key", "scanned", "asked_rules"))
    docs = docs.drop("secrets")
    names = [f"`{c}`" for c in docs.columns]
    docs = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    docs = docs.withColumn(key, F.xxhash64(*([F.col(doc)] if doc else []), F.col(body)))
    found = _candidates(docs, key, body, rules)
    if found is None:
        out = docs.withColumn(mine, F.array().cast("array<string>"))
    else:
        out = docs.join(found.withColumnRenamed("rules", mine).hint("shuffle_hash"), key, "left")
    asked = [f"coalesce(array_contains(`{mine}`, '{r.kind}'), false)" if trigram_query(r.pattern) else "true" for r in rules]
    spans = F.array_sort(F.concat(*[_found(f"`{body}`", asked[i], i, r) for i, r in enumerate(rules)]))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.get(kinds, s["rank"]).alias("kind")))
    return out.select(*names, spans.alias("secrets"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Secrets of a text from which on it is taken apart into code points, instead of one substring a secret.
MANY = 64


def redact(docs: DataFrame, mask: str = "[SECRET]", text: str = "text", **given) -> DataFrame:
    """Put ``mask`` in the place of every secret (overlapping ones count as one); other texts stay as they are.

    A text is put together once from what stands between its secrets.
    """
    out = scan(docs, text=text, **given)
    body = f"`{text}`"
    quoted = mask.replace("\\", "\\\\").replace("'", "\\'")
    # the farthest end up to each span, by doubling the distance
    ends = """aggregate(sequence(0, 30), transform(secrets, s -> s.end), (acc, j) -> IF(shiftleft(1, j) >= size(acc), acc,
        transform(acc, (x, i) -> greatest(x, IF(i >= shiftleft(1, j), acc[i - shiftleft(1, j)], 0L)))))"""

    def joined(part: str, rest: str) -> str:
        return f"""concat(array_join(transform(secrets, (s, i) -> IF(s.start >= IF(i = 0, 0L, ends[i - 1]),
            concat({part.format(a="IF(i = 0, 0L, ends[i - 1])", b="s.start")}, '{quoted}'), '')), ''), {rest.format(a="ends[size(ends) - 1]")})"""

    few = joined(f"substring({body}, int({{a}} + 1), int({{b}} - {{a}}))", f"substring({body}, int({{a}} + 1))")
    many = _once(f"split({body}, '')", "points", joined("array_join(slice(points, int({a} + 1), int({b} - {a})), '')",
                                                        "array_join(slice(points, int({a} + 1), size(points)), '')"))
    made = _once(ends, "ends", f"IF(size(ends) < {MANY}, {few}, {many})")
    return out.withColumn(text, F.expr(f"IF(size(secrets) = 0, {body}, {made})")).drop("secrets")

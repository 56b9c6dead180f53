"""Secret scan with a trigram index.

Native.  From the syntax tree of each rule's pattern a Boolean query over trigrams is derived
that every match must satisfy.  Texts are posted under the trigrams that the queries need; the
postings of a text are intersected into the set of trigrams it has, and only texts whose set
satisfies a rule's query are searched with its pattern.  A rule whose pattern has no mandatory
trigram is searched for in every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, sums_before

#: Classes of at most so many letters (case folded), and so many alternatives, are spelt out.
CLASS_LIMIT = 4
EXACT_LIMIT = 32
WORD_BITS = 60

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` (read alike by Python and Java); group ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # Runs are maximal, so the least length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$&*+=-]+@"),
)

# A query is True (any text), a trigram, or ("and" / "or", queries).


def both(op: str, queries: list) -> object:
    if op == "or" and any(q is True for q in queries):
        return True
    seen = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not seen else seen[0] if len(seen) == 1 else (op, tuple(seen))


def of_strings(strings: set[str]) -> object:
    """Texts that hold one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return True
    sets = {s: {s[i : i + 3] for i in range(len(s) - 2)} for s in strings}
    # A string that asks for more than another one does adds nothing.
    least = [s for s in sorted(strings) if not any(t != s and (sets[t] < sets[s] or sets[t] == sets[s] and t < s) for t in strings)]
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in least])


def spelt(op, arg) -> set[str] | None:
    """All folded strings that a node matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 2 * CLASS_LIMIT:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= CLASS_LIMIT + 1 else None
    if op is sre.SUBPATTERN:
        return spelt_all(arg[3])
    if op is sre.BRANCH:
        sets = [spelt_all(b) for b in arg[1]]
        if any(s is None for s in sets):
            return None
        union = set().union(*sets)
        return union if len(union) <= EXACT_LIMIT else None
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = spelt_all(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def spelt_all(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        own = spelt(op, arg)
        if own is None or len(out) * len(own) > EXACT_LIMIT:
            return None
        out = {a + b for a in out for b in own}
    return out


def of_nodes(nodes) -> object:
    """What every match of a sequence of nodes implies."""
    queries, run = [], {""}
    for op, arg in nodes:
        own = spelt(op, arg)
        if own is not None and len(run) * len(own) <= EXACT_LIMIT:
            run = {a + b for a in run for b in own}
            continue
        queries.append(of_strings(run))
        run = {""} if own is None else own
        if own is None:
            if op is sre.SUBPATTERN:
                queries.append(of_nodes(arg[3]))
            elif op is sre.BRANCH:
                queries.append(both("or", [of_nodes(b) for b in arg[1]]))
            elif op is sre.MAX_REPEAT and arg[0] > 0:
                queries.append(of_nodes(arg[2]))
    queries.append(of_strings(run))
    return both("and", queries)


def trigram_query(pattern: str) -> object:
    return of_nodes(parser.parse(pattern))


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def satisfied(query, has) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    cols = [satisfied(q, has) for q in query[1]]
    out = cols[0]
    for c in cols[1:]:
        out = (out & c) if query[0] == "and" else (out | c)
    return out


def postings(df: DataFrame, key: Column, text: Column, grams: list[str]) -> DataFrame:
    """``key``, ``gram`` (its number) for every trigram of the list that a text has."""
    folded = F.lower(text)
    present = F.array_compact(F.array(*[F.when(folded.contains(g), F.lit(i)) for i, g in enumerate(grams)]))
    return df.select(key.alias("_key"), F.explode(present).alias("gram"))


def intersected(posted: DataFrame, n: int) -> DataFrame:
    """The set of trigrams of each key, as bits of one or more numbers."""
    words = range((n + WORD_BITS - 1) // WORD_BITS)
    bits = [
        F.bit_or(
            F.when(
                F.floor(F.col("gram") / WORD_BITS) == w,
                F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % WORD_BITS),
            ).otherwise(F.lit(0).cast("long"))
        ).alias(f"_bits{w}")
        for w in words
    ]
    return posted.groupBy("_key").agg(*bits)


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule, in code points: lengths of the matches and of what lies between them."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        value,
        lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(v).alias("value")),
    )
    empty = F.array().cast(SPANS)

    def spans(known: Column) -> Column:
        ahead = sums_before(F.transform(known, lambda s: s["gap"] + F.coalesce(s["size"], F.lit(0))))
        placed = F.zip_with(known, ahead, lambda s, at: F.struct((at + s["gap"]).alias("start"), s["size"].alias("size"), s["value"].alias("value")))
        good = F.filter(placed, lambda s: s["size"].isNotNull() & (s["value"] >= rule.least))
        return F.transform(
            good,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + s["size"]).alias("end"), F.lit(rule.kind).alias("kind")
            ),
        ).cast(SPANS)

    # Almost all texts have no match; they stop here.
    return F.when(F.size(found) == 0, empty).otherwise(bound(steps, spans))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``: start, rank, end and kind of every secret, in order.

    Texts are posted under their hash, so copies share their postings and rows need no unique
    id; texts with the same hash share candidates, which are verified anyway.  A null text has no
    spans, as an empty one.  Rows that repeat give rows that repeat; no rows give no rows; other
    columns are not read.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(trigrams, queries.values())))
    number = {g: i for i, g in enumerate(grams)}
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    if grams:
        sets = intersected(postings(rows, F.col("_key"), F.col("_text"), grams), len(grams))
        rows = rows.join(sets, "_key", "left")

    def has(gram: str) -> Column:
        i = number[gram]
        return F.coalesce(F.col(f"_bits{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0, F.lit(False))

    empty = F.array().cast(SPANS)
    for rank, rule in enumerate(rules):
        spans = matches(F.col("_text"), rule, rank)
        candidate = satisfied(queries[rule.kind], has)
        rows = rows.withColumn(f"_s{rank}", spans if queries[rule.kind] is True else F.when(candidate, spans).otherwise(empty))
    return rows.select(*keep, F.sort_array(F.concat(*[f"_s{i}" for i in range(len(rules))])).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

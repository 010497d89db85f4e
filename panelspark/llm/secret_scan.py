"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query: what every match must contain,
lower-cased. The postings of the trigrams that rules ask for are built over all texts;
intersecting them gives each rule's candidate texts, and only those are searched with the
expression. Rules without mandatory trigrams search every text. Only DataFrame functions run.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as patterns

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.sources import stage

_MOST_STRINGS = 64
_SPANS = "array<struct<start:int,number:int,end:int,kind:string>>"
Clause = frozenset[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the expression, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules come first, in the order of their digest.
BASE_RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
        r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES


def _choices(items) -> set[str] | None:
    """The lower-cased characters of a small ASCII class.

    Other characters stand in no query: what Spark's lower() makes of them is its own affair,
    while it maps ASCII letters one by one and never puts anything between two of them.
    """
    found: set[str] = set()
    for kind, value in items:
        first, last = (value, value) if kind is patterns.LITERAL else value if kind is patterns.RANGE else (0, 999)
        if last >= 128 or last - first >= 4:
            return None
        found |= {chr(c).lower() for c in range(first, last + 1)}
    return found if len(found) <= 6 else None


class _Walk:
    """Follows an expression, holding the strings that may end here until they break off."""

    def __init__(self):
        self.clauses: set[Clause] = set()
        self.ends = {""}
        self.broken = False

    def append(self, strings: set[str] | None) -> None:
        if strings is None:
            self.flush()
            return
        longer = {a + b for a in self.ends for b in strings}
        if len(longer) > _MOST_STRINGS:
            self.flush()
            longer = set(strings)
        self.ends = longer

    def flush(self) -> None:
        self.broken = True
        if all(len(s) >= 3 for s in self.ends):
            parts = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in self.ends}
            self.clauses.add(frozenset(p for p in parts if not any(q < p for q in parts)))
        self.ends = {""}

    def visit(self, tokens) -> None:
        for kind, value in tokens:
            if kind is patterns.LITERAL:
                self.append(_choices([(kind, value)]))
            elif kind is patterns.IN:
                self.append(_choices(value))
            elif kind is patterns.SUBPATTERN:
                self.visit(value[3])
            elif kind is patterns.BRANCH:
                self.append(_union([_exact(option) for option in value[1]]))
            elif kind in (patterns.MAX_REPEAT, patterns.MIN_REPEAT):
                least, most, inner = value
                strings = _exact(inner)
                if least == 0 and most == 1 and strings is not None:
                    self.append(strings | {""})
                    continue
                for _ in range(min(least, 8) if strings is not None else 0):
                    self.append(strings)
                if least != most or strings is None or least > 8:
                    self.flush()
            else:
                self.flush()


def _union(options: list[set[str] | None]) -> set[str] | None:
    return None if any(o is None for o in options) else set().union(*options)


def _exact(tokens) -> set[str] | None:
    """All strings of an expression, lower-cased, if they are few; else None.

    A walk that broke off anywhere only knows how the strings end, so it tells nothing.
    """
    walk = _Walk()
    walk.visit(tokens)
    return None if walk.broken else walk.ends


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every match fulfils: one alternative's trigrams of each clause occur."""
    walk = _Walk()
    walk.visit(patterns.parse(pattern))
    walk.flush()
    return sorted(walk.clauses, key=lambda c: sorted(map(sorted, c)))


def trigram_postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, text_key): the texts in which each trigram that the rules ask for occurs."""
    asked = sorted({t for r in rules for c in trigram_query(r.pattern) for a in c for t in a})
    text = F.lower(F.col("text"))
    present = F.filter(F.array(*[F.lit(t) for t in asked]), lambda t: F.contains(F.col("lowered"), t))
    if not asked:
        return docs.select(F.lit("").alias("trigram"), "text_key").limit(0)
    return docs.select("text_key", text.alias("lowered")).select("text_key", F.explode(present).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, kinds): the rules whose trigram query a text fulfils, texts with none left out.

    The postings of each trigram are looked up in the table of alternatives that ask for it. A
    text is in the intersection of an alternative's postings when all its trigrams were met,
    and fulfils a rule when that holds for an alternative of every clause. The table is as long
    as the rules are, and is broadcast.
    """
    spark = postings.sparkSession
    asked = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        for number, clause in enumerate(query):
            for place, alternative in enumerate(sorted(clause, key=sorted)):
                asked += [(t, rule.kind, len(query), number, place, len(alternative)) for t in sorted(alternative)]
    table = spark.createDataFrame(asked, "trigram string, kind string, clauses int, clause int, place int, trigrams int")
    met = (
        postings.join(F.broadcast(table), "trigram")
        .groupBy("text_key", "kind", "clauses", "clause", "place", "trigrams")
        .agg(F.collect_set("trigram").alias("met"))
        .where(F.size("met") == F.col("trigrams"))
    )
    whole = (
        met.groupBy("text_key", "kind", "clauses")
        .agg(F.collect_set("clause").alias("met"))
        .where(F.size("met") == F.col("clauses"))
    )
    return whole.groupBy("text_key").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


_BLOCK = 256


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def _places(steps: Column) -> Column:
    """Sum of the elements before each element, by blocks, so a long array costs little more than a short one."""
    count = F.size(steps)

    def by_block(sums: Column) -> Column:
        before = F.transform(sums, lambda _, i: _total(F.slice(sums, F.lit(1), i)))

        def at(befores: Column) -> Column:
            return F.transform(
                steps,
                lambda _, i: F.element_at(befores, (i / _BLOCK).cast("int") + 1)
                + _total(F.slice(steps, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
            )

        return _let(before, at)

    blocks = F.sequence(F.lit(0), ((count - 1) / _BLOCK).cast("int"))
    return _let(F.transform(blocks, lambda b: _total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))), by_block)


def _spans(rule: Rule, number: int) -> Column:
    """Spans of a rule in column text: leftmost, not overlapping, in code points.

    The text is split at the matches of the same expression, so a match lies where the pieces
    and matches before it end, look-around included.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all("text", pattern, F.lit(rule.group))
    pieces = F.transform(F.split("text", pattern, -1), lambda p: F.length(p).cast("bigint"))
    sizes = F.transform(whole, lambda m: F.length(m).cast("bigint"))
    matches = F.arrays_zip(sizes.alias("size"), F.transform(part, F.length).alias("deep"), pieces.alias("before"))
    # There is one piece more than matches.
    found = F.filter(matches, lambda m: m["size"].isNotNull())

    def placed(found: Column) -> Column:
        steps = F.transform(found, lambda m: m["size"] + m["before"])
        spans = F.transform(
            F.arrays_zip(found.alias("m"), _let(steps, _places).alias("at")),
            lambda x: F.struct(
                (x["at"] + x["m"]["before"]).cast("int").alias("start"),
                F.lit(number).alias("number"),
                (x["at"] + x["m"]["before"] + x["m"]["size"]).cast("int").alias("end"),
                F.lit(rule.kind).alias("kind"),
                x["m"]["deep"].alias("deep"),
            ),
        )
        kept = F.filter(spans, lambda x: x["deep"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "number", "end", "kind")]))

    return F.when(F.regexp_like("text", pattern), _let(found, placed))


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text"
) -> DataFrame:
    """Rows of ``docs`` with column secret_spans: array of (start, number, end, kind).

    Spans are by start, then by the rule's place in ``rules``; start and end are code points,
    end exclusive. An expression must not match the empty string. Matches of one rule do not overlap; those of different rules may. Null and
    empty texts have none. All rows and columns stay as they are, but for a column named
    secret_spans, which this replaces. An empty table gives an empty one.
    """
    for rule in rules:
        if patterns.parse(rule.pattern).getwidth()[0] == 0:
            raise ValueError(f"the expression of rule {rule.kind!r} matches the empty string")
    kept = [c for c in docs.columns if c != "secret_spans"]
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text.alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    found = stage(candidates(trigram_postings(rows.select("text_key", "text"), rules), rules))
    marked = rows.join(found.withColumnRenamed("text_key", "found_key"), F.col("text_key") == F.col("found_key"), "left")
    lists = []
    for number, rule in enumerate(rules):
        spans = _spans(rule, number)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("kinds", rule.kind), spans)
        lists.append(F.coalesce(spans, F.array().cast(_SPANS)))
    spans = F.array_sort(F.flatten(F.array(*lists)))
    return marked.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], spans.alias("secret_spans"))


def told(spans: Column, rules: tuple[Rule, ...] | None = None) -> Column:
    """Spans as kind:start:end, comma-joined; ``rules`` limits the kinds."""
    if rules is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*[r.kind for r in rules]))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def found_of(spans: Column, rule: Rule) -> Column:
    """How many of the spans are of one rule."""
    return F.size(F.filter(spans, lambda s: s["kind"] == rule.kind)).cast("bigint")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each stretch of text covered by secrets replaced by ``mark``.

    Overlapping spans give one mark. Rows without secrets stay as they are; a column n_chars,
    if there is one, follows the new text.
    """
    found = find_secrets(docs, rules)
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        before = F.call_function("substring", F.col("text"), state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], before, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate("secret_spans", none, step)
    rest = F.concat(done["out"], F.call_function("substring", F.col("text"), done["at"] + 1))
    text = F.when(F.size("secret_spans") > 0, rest).otherwise(F.col("text"))
    out = found.withColumn("text", text).drop("secret_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns if c != "secret_spans"])

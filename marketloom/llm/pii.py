"""Personal data by bootstrapped contextual extraction, in DataFrame functions only (operator 5).

Base spans are the leftmost matches of four patterns that pass their checks: email, ip, card, phone.  They are
the seed instances.  The words around an instance form its lexical patterns: the two words before it
(``L``), and the word before with the word after (``B``).  Identifier-like tokens (letters, digits and
``._%+@-`` with at least one digit or @, five characters or more) outside base spans are the candidates.
Patterns and instances form a graph that is scored in ``ROUNDS`` rounds of joins and sums:

* a pattern's score for a kind is the sum of the scores of its distinct instances divided by their
  number plus one; it needs ``SUPPORT`` distinct seeds or accepted candidates of that kind;
* a candidate's score for a kind is 1 - product(1 - score) over its patterns.

Candidates that score ``ACCEPT`` or more are personal data of their best kind wherever they occur as a token.

Edges are made distinct before they are joined, so copies of a text and frequent contexts count
once per distinct instance.  Positions come from the lengths of matches and of the gaps between them.

Defined results: null text counts as empty; equal texts have equal spans; ties between kinds go to the
first in the order above; an empty table gives an empty table; other columns pass through (those called like a
result as ``_<name>``).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage, own_name

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, ACCEPT = 3, 3, 0.8
#: Spans of at most this size in memory (counted first) are broadcast to the rows; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

# The stated patterns; possessive repeats and look-behinds give the same matches without backtracking.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+"
_CHUNK = 256
#: Characters of a gap that hold its last words, mostly.
_NEAR = 80
#: Characters of a bucket of base spans.
_BUCKET = 4096


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of longs, in chunks so that long arrays take linear steps."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a"))
    sums = lambda v: F.aggregate(v, zero, step)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(values) - 1) / _CHUNK).cast("int"))
    cut = F.transform(F.arrays_zip(starts.alias("c"), F.array_repeat(values, F.size(starts)).alias("v")), _chunk)
    chunks = F.transform(cut, sums)
    totals = sums(F.transform(chunks, lambda c: c["s"]))["a"]
    shifted = F.transform(
        F.arrays_zip(chunks.alias("c"), totals.alias("t")),
        lambda x: F.transform(F.arrays_zip(x["c"]["a"].alias("a"), F.array_repeat(x["t"] - x["c"]["s"], F.size(x["c"]["a"])).alias("b")), lambda y: y["a"] + y["b"]),
    )
    return F.when(F.size(values) <= _CHUNK, sums(values)["a"]).otherwise(F.flatten(shifted))


def _chunk(x: Column) -> Column:
    return F.slice(x["v"], x["c"] * _CHUNK + 1, F.lit(_CHUNK))


def _words_before(gap: Column, n: int) -> Column:
    """The last ``n`` words of a gap, joined by blanks; the end of the gap is enough if more words than that begin in it."""
    words = lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")
    end = words(F.right(gap, F.lit(_NEAR)))
    every = F.when((F.length(gap) <= _NEAR) | (F.size(end) > n), end).otherwise(words(gap))
    return F.array_join(F.slice(every, F.greatest(F.lit(1), F.size(every) - n + 1), F.lit(n)), " ")


def _word_after(gap: Column) -> Column:
    return F.lower(F.regexp_extract(gap, r"^\s*(\S+)", 1))


def _with_matches(df: DataFrame, text: Column, patterns: dict[str, str], passes: dict) -> DataFrame:
    """``df`` with an array of (start, end, value, before, last, after) for each pattern's good matches.

    Each step is a column of its own, so that no text is scanned again for every match.
    """
    maybe = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    values = {n: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()}
    df = df.withColumns({f"_v_{n}": F.when(maybe[n], v) if n in maybe else v for n, v in values.items()})
    df = df.withColumns({f"_g_{n}": F.when(F.size(f"_v_{n}") > 0, F.split(text, p, -1)) for n, p in patterns.items()})
    length = lambda x: (F.length(x["v"]) + F.length(x["g"])).cast("long")
    zipped = {n: F.slice(F.arrays_zip(F.col(f"_v_{n}").alias("v"), F.col(f"_g_{n}").alias("g")), 1, F.size(f"_v_{n}")) for n in patterns}
    df = df.withColumns({f"_n_{n}": F.when(F.col(f"_g_{n}").isNotNull(), F.transform(z, length)) for n, z in zipped.items()})
    df = df.withColumns({f"_e_{n}": running_sums(F.col(f"_n_{n}")) for n in patterns})
    out = {}
    for n in patterns:
        gap = F.col(f"_g_{n}")
        rows = F.arrays_zip(
            F.col(f"_v_{n}").alias("v"), F.col(f"_e_{n}").alias("e"), gap.alias("g"), F.slice(gap, 2, F.size(gap)).alias("h")
        )
        good = F.filter(rows, _filter_on(passes[n]))
        out[f"_m_{n}"] = F.when(gap.isNotNull(), F.transform(good, _placed))
    df = df.withColumns(out)
    return df.drop(*[f"_{c}_{n}" for c in "vgne" for n in patterns])


def _filter_on(passes):
    return lambda x: x["v"].isNotNull() & passes(x["v"])


def _placed(x: Column) -> Column:
    return F.struct(
        (x["e"] - F.length(x["v"])).alias("start"),
        x["e"].alias("end"),
        x["v"].alias("value"),
        _words_before(x["g"], 2).alias("before"),
        _words_before(x["g"], 1).alias("last"),
        _word_after(x["h"]).alias("after"),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _numbered(matches: Column, number: int) -> Column:
    rest = ("end", "value", "before", "last", "after")
    return F.transform(matches, lambda m: F.struct(m["start"], F.lit(number).alias("kind"), *[m[x] for x in rest]))


def with_base_spans(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with an array of (start, kind number, end, value, before, last, after), sorted by start, then kind."""
    passes = {kind: partial(_passes, kind) for kind in KINDS}
    df = _with_matches(df, F.coalesce(F.col(text), F.lit("")), _PATTERNS, passes)
    found = [F.coalesce(_numbered(F.col(f"_m_{kind}"), i), F.slice(F.array(_no_span()), 1, 0)) for i, kind in enumerate(KINDS)]
    return df.withColumn(into, F.array_sort(F.concat(*found))).drop(*[f"_m_{kind}" for kind in KINDS])


def _no_span() -> Column:
    texts = [F.lit("").alias(n) for n in ("value", "before", "last", "after")]
    return F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("end"), *texts)


def with_candidates(df: DataFrame, text: str, base: str, into: str) -> DataFrame:
    """``df`` with an array of identifier-like tokens that no base span touches.

    Base spans are put in buckets of the text first, so that a token meets only those near it.
    """
    df = _with_matches(df, F.coalesce(F.col(text), F.lit("")), {"token": _TOKEN}, {"token": lambda v: F.length(v) >= 5})
    last = F.greatest(F.lit(0), F.floor(F.length(text) / _BUCKET)).cast("int")
    near = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.filter(base, lambda b: (b["start"] < (k + 1) * _BUCKET) & (b["end"] >= k * _BUCKET)),
    )
    df = df.withColumn("_near", F.when(F.size(base) > 0, near))
    meets = lambda m, at: F.exists(F.get("_near", F.floor(at / _BUCKET).cast("int")), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    free = F.filter("_m_token", lambda m: ~F.coalesce(meets(m, m["start"]) | meets(m, m["end"]), F.lit(False)))
    return df.withColumn(into, free).drop("_m_token", "_near")


def _contexts(m: str) -> Column:
    c = F.col(m)
    both = F.when(
        (c["last"] != "") & (c["after"] != ""), F.concat(F.lit("B "), c["last"], F.lit(" _ "), c["after"])
    )
    left = F.when(F.contains(c["before"], F.lit(" ")), F.concat(F.lit("L "), c["before"]))
    return F.explode(F.array_compact(F.array(left, both)))


def accepted_values(slim: DataFrame) -> DataFrame:
    """(value, kind) of the candidates that the graph accepts; ``slim`` has columns base and cand (arrays)."""
    seeds = slim.select(F.explode("base").alias("m")).select(
        _contexts("m").alias("pattern"), F.col("m.value").alias("value"), F.col("m.kind").alias("kind")
    )
    seeds = cut_lineage(seeds.distinct())
    tokens = slim.select(F.explode("cand").alias("m")).select(_contexts("m").alias("pattern"), F.col("m.value").alias("value"))
    known = seeds.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_seeds"))
    tokens = tokens.distinct().join(known.select(F.col("pattern").alias("p")), F.col("pattern") == F.col("p"), "left_semi")
    tokens = cut_lineage(tokens)  # only tokens in a context that some seed has can ever score
    size = tokens.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_tokens"))
    size = known.join(size, "pattern", "left").select(
        "pattern", (F.col("n_seeds") + F.coalesce("n_tokens", F.lit(0))).alias("n_all")
    )
    size = cut_lineage(size)
    base = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    scored: DataFrame | None = None
    for _ in range(ROUNDS):
        parts = base.select("pattern", "kind", F.col("seeds").cast("double").alias("mass"), F.col("seeds").alias("support"))
        if scored is not None:
            more = tokens.join(scored, "value").groupBy("pattern", "kind")
            more = more.agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= ACCEPT).alias("support"))
            parts = parts.union(more)
        patterns = parts.groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"), F.sum("support").alias("support"))
        patterns = patterns.where(F.col("support") >= SUPPORT).join(size, "pattern")
        patterns = patterns.select("pattern", "kind", (F.col("mass") / (F.col("n_all") + 1)).alias("weight"))
        by_value = tokens.join(patterns, "pattern").groupBy("value", "kind")
        scored = cut_lineage(by_value.agg((1 - F.exp(F.sum(F.log1p(-F.col("weight"))))).alias("score")))
    best = scored.where(F.col("score") >= ACCEPT).groupBy("value")
    return best.agg(F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind"))


def find_pii(docs: DataFrame, *, text: str = "text", base: str = "base_pii", into: str = "pii") -> DataFrame:
    """``docs`` with two arrays of (start, kind number, end), sorted: the base spans, and those with the found ones.

    Texts are scanned once; the spans of distinct texts, known by two hashes, are joined with the rows.
    """
    mark = lambda t: [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2")]
    slim = docs.select(docs[text].alias("t"), *mark(docs[text])).where(F.coalesce(F.col("t"), F.lit("")).rlike("[0-9@]"))
    slim = with_candidates(with_base_spans(slim, "t", "base"), "t", "base", "cand").drop("t").dropDuplicates(["h1", "h2"])
    # above an aggregation, so that the condition isn't pushed down into the scan, where it would find the spans again
    slim = cut_lineage(slim.where(F.size("base") + F.coalesce(F.size("cand"), F.lit(0)) > 0))
    good = accepted_values(slim)
    spans = slim.select("h1", "h2", F.explode("cand").alias("m")).select(
        "h1", "h2", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("value")
    )
    spans = spans.join(good, "value").select("h1", "h2", F.struct("start", "kind", "end").alias("s"))
    more = spans.groupBy("h1", "h2").agg(F.collect_set("s").alias("more"))
    found = slim.select("h1", "h2", F.transform("base", lambda b: F.struct(b["start"], b["kind"], b["end"])).alias("bare"))
    found = found.join(more, ["h1", "h2"], "left").withColumn(
        "every", F.when(F.col("more").isNull(), F.col("bare")).otherwise(F.array_sort(F.concat("bare", "more")))
    )
    found = cut_lineage(found.where(F.size("bare") + F.coalesce(F.size("more"), F.lit(0)) > 0).drop("more"))
    size = found.agg(F.coalesce(F.sum(48 + 32 * (F.size("bare") + F.size("every"))), F.lit(0)).alias("n")).first()["n"]
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    # the rows' own columns travel in a struct, so that none of their names can clash
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *mark(docs[text]))
    out = rows.join(found, ["h1", "h2"], "left")
    spans_of = lambda c: F.coalesce(c, F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>"))
    own = [F.col("row")[c].alias(own_name(docs, f"_{c}") if c.lower() in (base.lower(), into.lower()) else c) for c in docs.columns]
    return out.select(*own, spans_of(F.col("bare")).alias(base), spans_of(F.col("every")).alias(into))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(spans: Column, number: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def redacted(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets, and n_chars, if there is one, anew."""
    base, every = own_name(docs, "_base"), own_name(docs, "_pii")
    found = find_pii(docs, text=text, base=base, into=every)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    old = F.col(text)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(old, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        apart = s["start"] >= acc["at"]
        more = F.when(apart, F.array(gap, F.get(names, s["kind"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], more).alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(old, (acc["at"] + 1).cast("int"), F.length(old)))

    new = F.when(F.size(every) > 0, F.aggregate(F.col(every), begin, step, finish)).otherwise(old)
    out = found.withColumn(text, new).drop(base, every)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out

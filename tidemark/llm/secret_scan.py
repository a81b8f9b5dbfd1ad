"""Secret scan by patterns and sliding-window entropy, in built-in functions only.

Base spans come from three patterns. A candidate string is a run of token characters that mixes letters and
digits. For each character class, a window slides over the candidate; the counts of its characters and the sum of
c log2 c change by the character that enters and the one that leaves, which gives the window's Shannon entropy
without counting anew. A candidate whose best window reaches the threshold of its class becomes a span of kind
`entropy`, unless an allow-list pattern matches it or a base span overlaps it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Class name, alphabet, and least entropy (bits) of the best window.
CLASSES = (("hex", "0123456789abcdefABCDEF", 2.9), ("token", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.6))
ALLOW = (r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"(?i)example|sample|placeholder|dummy|your[-_]", r"^/[A-Za-z0-9_=/-]*$")
WINDOW = 20


#: Values of an array that are added up one after the other before the sums of such stretches are.
CHUNK = 128
INTS = "array<int>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column) -> Column:
    """Sums of an array of ints up to each of them. An array that grows by one value is copied, so it only ever grows to CHUNK values."""

    def sums(part: Column, name: str) -> Column:
        def step(state, x):
            total = state["s"] + x
            return F.struct(total.alias("s"), F.concat(state["out"], F.array({"upto": total, "before": state["s"]}[name])).alias("out"))

        return F.aggregate(part, F.struct(F.lit(0).alias("s"), F.array().cast(INTS).alias("out")), step, lambda state: state["out"])

    def scan(v: Column) -> Column:
        at = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast(INTS))
        stretches = F.transform(at, lambda k: sums(F.slice(v, k * CHUNK + 1, F.lit(CHUNK)), "upto"))
        return _let(stretches, lambda own: F.flatten(F.zip_with(own, sums(F.transform(own, lambda part: F.element_at(part, -1)), "before"), lambda part, before: F.transform(part, lambda x: x + before))))

    return _let(values, scan)


def below(points: Column, asked: Column) -> Column:
    """For each of the rising ints `asked`, how many points are smaller: both in one sorted array, in which points are counted."""
    both = F.array_sort(F.concat(F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(1).alias("point"))), F.transform(asked, lambda q: F.struct(q.alias("at"), F.lit(0).alias("point")))))

    def counted(events: Column) -> Column:
        sums = running(F.transform(events, lambda e: e["point"]))
        return F.transform(F.filter(F.zip_with(events, sums, lambda e, n: F.struct(e["point"].alias("point"), n.alias("n"))), lambda e: e["point"] == 0), lambda e: e["n"])

    return _let(both, counted)


def _at(text: Column, pattern: str, keep=None) -> Column:
    """Matches of the pattern as m, start and end (code points): what stands between the matches gives their places.

    keep: of the length of the second group, whether a match counts.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep is not None else found
    parts = F.zip_with(F.arrays_zip(found.alias("m"), groups.alias("g")), F.slice(gaps, 1, F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m["m"]).alias("n"), F.length(m["g"]).alias("g"), m["m"].alias("m")))

    def placed(p: Column) -> Column:
        spans = F.zip_with(p, running(F.transform(p, lambda x: x["gap"] + x["n"])), lambda x, end: F.struct(x["m"].alias("m"), (end - x["n"]).alias("start"), end.alias("end"), x["g"].alias("g")))
        kept = spans if keep is None else F.filter(spans, lambda x: keep(x["g"]))
        return F.transform(kept, lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), _let(parts, placed)).otherwise(F.array().cast("array<struct<m:string,start:int,end:int>>"))


def best_entropy(candidate: Column, alphabet: str, window: int) -> Column:
    """Largest entropy of any `window` consecutive characters of the alphabet inside candidate; 0 without one."""
    table = F.array(*[F.lit(0.0), *[F.lit(c * math.log2(c)) for c in range(1, window + 1)]])
    place = F.transform(F.split(candidate, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(alphabet), c)))
    zero = F.array_repeat(F.lit(0), len(alphabet))
    queue = F.array().cast("array<int>")

    def step(s, c):
        full = F.size(s["queue"]) == window
        out = F.when(full, F.element_at(s["queue"], 1)).otherwise(F.lit(0))
        had_out = F.when(out > 0, F.element_at(s["counts"], F.greatest(out, F.lit(1)))).otherwise(F.lit(0))
        less = s["sum"] - F.when(out > 0, F.element_at(table, had_out + 1) - F.element_at(table, F.greatest(had_out, F.lit(1)))).otherwise(F.lit(0.0))
        had = F.element_at(s["counts"], F.greatest(c, F.lit(1))) - F.when(out == c, 1).otherwise(0)
        total = less + F.element_at(table, had + 2) - F.element_at(table, had + 1)
        counts = F.transform(s["counts"], lambda n, j: n + F.when(j + 1 == c, 1).otherwise(0) - F.when(j + 1 == out, 1).otherwise(0))
        held = F.concat(F.when(full, F.slice(s["queue"], 2, window)).otherwise(s["queue"]), F.array(c))
        best = F.when(F.size(s["queue"]) >= window - 1, F.greatest(s["best"], F.lit(math.log2(window)) - total / window)).otherwise(s["best"])
        on = F.struct(counts.alias("counts"), held.alias("queue"), total.alias("sum"), best.alias("best"))
        off = F.struct(zero.alias("counts"), queue.alias("queue"), F.lit(0.0).alias("sum"), s["best"].alias("best"))
        return F.when(c > 0, on).otherwise(off)

    first = F.struct(zero.alias("counts"), queue.alias("queue"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(place, first, step, lambda s: s["best"])


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, window: int = WINDOW, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and text of every row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null text counts as empty,
    which has no spans. Null ids and repeated rows are passed through, one result for each row; other columns
    are ignored. Patterns look at whole texts, however long: none repeats a group of variable length, so none recurses
    with the length of a match; work grows in proportion to a text and its matches. An empty table gives an empty result.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    found = rows.withColumns({"assign": _at(F.col("text"), ASSIGN, lambda n: n >= 12), "access": _at(F.col("text"), ACCESS), "hex": _at(F.col("text"), HEX), "candidate": _at(F.col("text"), CANDIDATE)})
    base = found.withColumn("base", F.concat(_tagged(F.col("assign"), 0), _tagged(F.col("access"), 1), _tagged(F.col("hex"), 2)))

    # of spans that begin before a candidate ends, those that end before it begins don't overlap it
    began = below(F.transform("base", lambda b: b["start"]), F.transform("candidate", lambda s: s["end"]))
    ended = below(F.transform("base", lambda b: b["end"]), F.transform("candidate", lambda s: s["start"] + 1))
    free = F.zip_with(F.col("candidate"), F.zip_with(began, ended, lambda a, b: a - b), lambda s, n: F.struct(s["m"].alias("m"), s["start"].alias("start"), s["end"].alias("end"), n.alias("n")))

    def secret(s: Column) -> Column:
        value = s["m"]
        ok = (s["n"] == 0) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        for pattern in allow:
            ok &= ~value.rlike(pattern)
        high = F.lit(False)
        for _, alphabet, least in classes:
            high |= best_entropy(value, alphabet, window) >= least
        return F.when(ok, high).otherwise(False)

    added = base.withColumn("added", F.when(F.size("candidate") > 0, F.filter(free, secret)).otherwise(F.array().cast("array<struct<m:string,start:int,end:int,n:int>>")))
    return added.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", _tagged(F.col("added"), 3))).alias("spans"), "text",
    )

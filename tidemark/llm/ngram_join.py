"""N-gram Jaccard join by vertical partitioning.

Documents with the same set are one class, so copies cost nothing. Sets that cannot have a partner go first: of its
first m n-grams in the order of their hashes, a set with a partner shares at least m - p + 1 with it, where p is
n - ceil(t n) + 1, so that many must occur in some other class; each set puts in enough for partners of all sizes.
For the sets that stay, all n-grams are counted, and the global order is that of frequency, rare ones first. It is
cut into fragments at quantiles, so each fragment holds as many n-grams as the next, and every set becomes one
segment in each. The posting lists of the rarest p n-grams of each set, its share of the head of the order, give
candidate pairs; the place of an n-gram in both sets and a parity signature rule pairs out. What is left is counted
fragment by fragment: each gives partial overlaps of its segments, and the counts of a pair are summed.

A list of very many sets that share an n-gram and link never becomes all of its pairs. In star rounds every list
compares its sets with one pivot only, in each round another; what proves linked is one component. Lists within a
component are done. In the end all pairs of a list that lie in different components and have not been compared are,
unless parity signatures show that they differ too much; so no link between different components is lost, and links
within one cannot change the components. Sets that share rare n-grams and yet do not link are met pair by pair in
that last step: it is quadratic in the length of such a list (see README). Lists of more than HOT sets are dealt out
by a salt as well as by their n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import Words, column, cut, documents, grams, lower_ascii, mix, packed, release, signed, slices, stage
from tidemark.llm.components import components

WORDS, PER_CENT, FRAGMENTS = 5, 80, 4
#: Share of m in p that is looked at beyond p, in per cent; it only saves work.
BEYOND = 50
#: At most so many star rounds; they only save work.
STARS = 3
#: Bits of a set's parity signature.
BITS = 512
#: Sets from which on a list is dealt out over SALTS places.
HOT, SALTS = 1_000, 16


def _shingles(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offsets = packed(texts)
    for i, j in slices(offsets):
        words = Words(lower_ascii(buf[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
        whole = grams(words.hash, k)
        for f, m in zip(words.first.tolist(), words.count.tolist(), strict=True):
            yield np.unique(whole[f : f + m - k + 1]) if m >= k else grams(words.hash[f : f + m], m) if m else np.zeros(0, np.uint64)


def _fingerprint(x: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(x ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True) + np.uint64(len(x))).view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)))


def _sets(k: int, per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            size, cid, first = [], [], []
            for x in _shingles(column(batch, "text"), k):
                n = len(x)
                size.append(n)
                cid.append(_fingerprint(x) if n else None)
                first.append(x[: _looked_at(n, per_cent)])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "uid"), pa.array(size, pa.int64()), pa.array(cid, pa.int64()), _lists(first)], ["doc_id", "uid", "n", "cid", "first"])

    return run


def _prefix(n, per_cent: int):
    """n - ceil(per_cent n / 100) + 1, for numbers and columns."""
    return n - (F.ceil(n * per_cent / 100) if isinstance(n, Column) else -(-per_cent * n // 100)) + 1


def _beyond(n, per_cent: int):
    p = _prefix(n, per_cent)
    return F.least(F.floor(p * BEYOND / 100), n - p) if isinstance(n, Column) else min(p * BEYOND // 100, n - p)


@cache
def _looked_at(n: int, per_cent: int) -> int:
    """How many of a set's first n-grams are looked at: m, or as many as a larger partner needs to find its m - p + 1.

    With overlap o, the first m of a set of n hold at least m - (n - o) of those that both share, in the order of both.
    """
    m = _prefix(n, per_cent) + _beyond(n, per_cent)
    return max([m, *(n + per_cent * (n + a) // -(100 + per_cent) + _beyond(a, per_cent) + 1 for a in range(n + 1, 100 * n // per_cent + 1))])


def _grams(k: int):
    """n-grams and parity signature of one text of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            sets = list(_shingles(column(batch, "text"), k))
            odd = [np.packbits(np.bincount((x & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).view(np.uint64) for x in sets]
            yield pa.RecordBatch.from_arrays([column(batch, "cid"), column(batch, "n"), _lists(odd), _lists(sets)], ["cid", "n", "bits", "grams"])

    return run


def _order() -> Column:
    """Place of an n-gram h in the global order: frequency first (up to 32,767), then its hash."""
    return F.shiftleft(F.least("df", F.lit(32_767)).cast("long"), 48).bitwiseOR(F.shiftrightunsigned("h", 16))


def _cut_order(ordered: DataFrame, fragments: int) -> DataFrame:
    """cid, f and seg: the n-grams of each set in each fragment of the global order, which is cut at quantiles."""
    shares = [i / fragments for i in range(1, fragments)]
    ends = ordered.select(F.explode("grams.o").alias("o")).agg(F.approx_percentile("o", shares, 1_000)).first()[0] or []
    bounds = [-1, *ends, (1 << 63) - 1]

    def inside(low: int, high: int) -> Column:
        return F.transform(F.filter("grams", lambda g: (g["o"] > low) & (g["o"] <= high)), lambda g: g["h"])

    each = [F.struct(F.lit(f).alias("f"), inside(*ends).alias("seg")) for f, ends in enumerate(zip(bounds, bounds[1:], strict=False))]
    return ordered.select("cid", F.inline(F.array(*each))).where(F.size("seg") > 0)


def _links(pairs: DataFrame, segments: DataFrame, per_cent: int) -> DataFrame:
    """Those of pairs (a, b, na, nb) that reach the threshold: partial overlaps by fragment, summed by pair."""
    pairs = pairs.select("a", "b", "na", "nb")
    left = pairs.join(segments.select(F.col("cid").alias("a"), "f", F.col("seg").alias("sa")), "a")
    right = segments.select(F.col("cid").alias("b"), "f", F.col("seg").alias("sb")).join(pairs.select("b").distinct(), "b", "left_semi")
    partial = left.join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(F.lit(100 + per_cent) * F.col("o") >= F.lit(per_cent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _salt() -> Column:
    """Where a set's posting in a hot list goes."""
    return F.when(F.col("df") > HOT, F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))


def _salts() -> Column:
    """All places of a list, for what meets every posting of it."""
    return F.explode(F.sequence(F.lit(0), F.when(F.col("df") > HOT, SALTS - 1).otherwise(0))).alias("salt")


def _differ() -> Column:
    """Bits in which the signatures bits and other_bits differ."""
    each = [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("other_bits", F.lit(i)))) for i in range(BITS // 64)]
    return sum(each[1:], each[0])


def _near(per_cent: int, n: str = "n", other_n: str = "other_n") -> Column:
    """Whether signatures allow a link: each n-gram that only one of two sets has flips one bit, so they differ in at least as many n-grams as bits."""
    return F.lit(100 + per_cent) * _differ() <= F.lit(100 - per_cent) * (F.col(n) + F.col(other_n))


def _pair(rows: DataFrame, per_cent: int, *more: tuple[str, str]) -> DataFrame:
    """Distinct pairs a < b of rows (cid, n, i, other, other_n, other_i) that lengths and places of the n-gram allow to link.

    i is the n-gram's place in its set. If it is the first that both share, the overlap is one more at most than
    what follows it in either; if it isn't, the first one's list has the pair. more: names x whose columns x and
    other_x become the pair's x of a and of b.
    """
    overlap = F.least(F.col("n") - F.col("i"), F.col("other_n") - F.col("other_i")) + 1
    fits = F.lit(100 + per_cent) * overlap >= F.lit(per_cent) * (F.col("n") + F.col("other_n"))
    first = F.col("cid") < F.col("other")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    extra = [c for x, name in more for c in (pick(x, f"other_{x}").alias(f"{name}a"), pick(f"other_{x}", x).alias(f"{name}b"))]
    return rows.where((F.col("cid") != F.col("other")) & fits).select(pick("cid", "other").alias("a"), pick("other", "cid").alias("b"), pick("n", "other_n").alias("na"), pick("other_n", "n").alias("nb"), *extra).distinct()


def _labelled(postings: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Postings (h, cid, n, i, df, salt) with comp, of the lists that hold more than one component."""
    if comp is None:
        rows = postings.withColumn("comp", F.col("cid"))
    else:
        rows = postings.join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    rows = stage(rows.select("h", "salt", "df", "cid", "n", "i", "comp"), "postings")
    sizes = rows.groupBy("h", "df", "comp").agg(F.count("*").alias("size")).groupBy("h", "df").agg(F.sum("size").alias("all"), F.max(F.struct("size", "comp")).alias("big"))
    mixed = stage(sizes.where("all > big.size").select("h", "df", "all", F.col("big.size").alias("most"), F.col("big.comp").alias("big")), "mixed")
    out = stage(rows.join(mixed.select("h", "all", "most", "big", _salts()).hint("merge"), ["h", "salt"]), "open")
    release(rows, mixed)
    return out


def _rest(lists: DataFrame, signatures: DataFrame, checked: DataFrame, links: DataFrame, segments: DataFrame, per_cent: int) -> DataFrame:
    """Components once every pair of a list that lies in two of them is compared or shown to be apart.

    Of the pairs between the same two components the likeliest goes first: if it links, the others need no look.
    """
    unsigned, lists = lists, stage(lists.join(signatures, "cid"), "signed")
    release(unsigned)
    outer = lists.where("comp <> big").select("h", _salts(), *[F.col(c).alias(f"other_{c}") for c in ("n", "i", "comp", "bits")], F.col("cid").alias("other"))
    apart = (F.col("comp") != F.col("other_comp")) & ((F.col("comp") == F.col("big")) | (F.col("cid") < F.col("other")))
    rows = lists.join(outer.hint("merge"), ["h", "salt"]).where(apart & _near(per_cent)).withColumn("d", _differ()).withColumn("other_d", F.col("d"))
    pairs = stage(_pair(rows, per_cent, ("comp", "c"), ("d", "d")).join(checked, ["a", "b"], "left_anti"), "pairs")
    release(lists)
    best = pairs.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.min(F.struct("da", "a", "b", "na", "nb")).alias("p")).select("p.*")
    best = stage(best, "best")
    links = links.union(stage(_links(best, segments, per_cent), "linked"))
    comp = components(links)
    found = [comp.select(F.col("node").alias(f"c{x}"), F.col("comp").alias(f"now_{x}")) for x in "ab"]
    left = pairs.drop("ca", "cb").withColumns({"ca": F.col("a"), "cb": F.col("b")}).join(found[0], "ca", "left").join(found[1], "cb", "left")
    left = left.where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).join(best, ["a", "b"], "left_anti").select("a", "b", "na", "nb")
    left = stage(left, "left")
    release(pairs, best)
    if left.isEmpty():
        return comp
    more = stage(_links(left, segments, per_cent), "linked")
    return comp if more.isEmpty() else components(links.union(more))


def ngram_join(docs: DataFrame, k: int = WORDS, per_cent: int = PER_CENT, fragments: int = FRAGMENTS, stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles, component_id, component and uid of every row of docs (doc_id, text).

    A text's set holds its k-word shingles after lower-casing A-Z; with fewer words, the whole sequence as one; a
    null text or one without words has none and is linked with nothing. Two rows link when 100 * intersection >=
    per_cent * union. component_id is the smallest doc_id that links reach, the row's own included; null ids count
    only where there is no other. component is a key of the component itself, as two of them may have the same
    smallest id where ids repeat. Every row is a document, also if its id occurs again; other columns are ignored,
    whatever their names. Very long texts are sets like others, held one at a time; an empty table gives an empty result.
    """
    if fragments < 1:
        raise ValueError("there must be a fragment")
    docs = documents(docs)
    whole = stage(docs.mapInArrow(_sets(k, per_cent), "doc_id long, uid long, n long, cid long, first array<long>"), "sets")
    sets = stage(whole.drop("first"), "classes")

    # sets of which enough of the first n-grams occur in other classes; joins by n-gram are hinted, as both sides grow with the input
    entries = whole.select(F.explode("first").alias("h"), "cid", "uid")
    shared = stage(entries.groupBy("h").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least <> most").select("h"), "shared")
    found = entries.select("h", "uid").join(shared.hint("merge"), "h").groupBy("uid").agg(F.count("*").alias("has")).join(sets.select("uid", "cid", "n").distinct(), "uid")
    holder = stage(found.where(F.col("has") > _beyond(F.col("n"), per_cent)).groupBy("cid", "n").agg(F.min("uid").alias("uid")), "holders")
    release(whole, shared)
    one = docs.join(holder.hint("merge"), "uid").groupBy("uid", "cid", "n").agg(F.first("text").alias("text"))
    held = stage(one.mapInArrow(_grams(k), "cid long, n long, bits array<long>, grams array<long>"), "held")
    release(holder)

    # their n-grams in the order of frequency; the ones that no other set has come first and give no candidates
    entries = held.select(F.explode("grams").alias("h"), "cid", "n")
    often = stage(entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = entries.join(often.hint("merge"), "h").select("cid", "n", F.struct(_order().alias("o"), "h").alias("g")).repartition("cid")
    ordered = stage(ranked.groupBy("cid", "n").agg(F.sort_array(F.collect_list("g")).alias("grams")).where(F.lit(100) * F.size("grams") >= F.lit(per_cent) * F.col("n")), "ordered")
    signatures = stage(held.select("cid", "bits"), "signatures")
    release(held, often)
    segments = stage(_cut_order(ordered, fragments), "segments")
    private = F.col("n") - F.size("grams")
    head = F.slice("grams", F.lit(1), F.greatest(_prefix(F.col("n"), per_cent) - private, F.lit(0)).cast("int"))
    postings = ordered.select("cid", "n", private.alias("private"), F.posexplode(head).alias("i", "g"))
    postings = postings.select("cid", "n", (F.col("i") + 1 + F.col("private")).alias("i"), "g.h", F.shiftright("g.o", 48).alias("df"))
    postings = stage(postings.withColumn("salt", _salt()), "lists")
    release(ordered)

    comp = checked = links = None
    for r in range(stars + 1):
        lists = _labelled(postings, comp)
        load = lists.select("h", "all", "most").distinct().agg(F.sum(F.col("all") - F.col("most")).alias("rows"), F.sum((F.col("all") - F.col("most")) * F.col("all")).alias("pairs")).first()
        if not load["rows"]:
            release(lists)
            break
        if r > 0 and (r == stars or load["pairs"] <= 8 * load["rows"]):
            comp = _rest(lists, signatures, checked, links, segments, per_cent)
            break
        pivots = lists.groupBy("h", "df").agg(F.min(F.struct(F.xxhash64("cid", F.lit(r)).alias("r"), "cid", "n", "i", "comp")).alias("p"))
        pivots = pivots.select("h", _salts(), F.col("p.cid").alias("other"), F.col("p.n").alias("other_n"), F.col("p.i").alias("other_i"), F.col("p.comp").alias("other_comp"))
        pairs = _pair(lists.join(pivots.hint("merge"), ["h", "salt"]).where("comp <> other_comp"), per_cent)
        pairs = stage(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        release(lists)
        checked = pairs.select("a", "b") if checked is None else checked.union(pairs.select("a", "b"))
        both = pairs.join(signatures.select(F.col("cid").alias("a"), "bits"), "a").join(signatures.select(F.col("cid").alias("b"), F.col("bits").alias("other_bits")), "b")
        likely = stage(both.where(_near(per_cent, "na", "nb")).select("a", "b", "na", "nb"), "likely")
        new = stage(_links(likely, segments, per_cent), "linked")
        release(likely)
        links = new if links is None else links.union(new)
        comp = components(links)

    release(signatures, segments, postings)
    low = sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"))
    if comp is None:
        low = low.withColumn("comp", F.col("cid"))
    else:
        low = stage(low.join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "lows")
        low = low.select("cid", "comp").join(low.groupBy("comp").agg(F.min("low").alias("low")), "comp")
    owner = stage(low.select("cid", "comp", F.col("low").alias("component_id")), "owners")
    some = F.col("n") > 0
    return sets.join(owner, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("comp")).otherwise(F.col("uid")).alias("component"), "uid")

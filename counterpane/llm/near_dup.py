"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first scatters shingle numbers, the second, circularly shifted
by k, gives coordinate k. As tables this means that the K values of one shingle are K neighbouring entries of the second
table, so a signature is the column minimum of windows of that table.

A document is the set of its distinct word shingles. Documents with equal sets (by digests, then confirmed on the exact
sets) collapse to one representative before anything is compared. Bands of the signature put representatives into buckets; each bucket compares its members with
one leader (chosen by hash, in a few orders that the bands share), and components are formed from the links confirmed on the full
sets. Buckets that still hold several components compare the members outside the largest one with the rest of the
bucket, except pairs that the exact distances to the leader rule out (Jaccard distance is a metric), inside tasks and in
blocks. So no link between documents that share a bucket is lost, and no pairs but those with a leader become rows.

The chance that two documents at the threshold of 0.85 share no bucket is (1 - 0.85**ROWS)**BANDS, below 1e-6.

Defined results: null and empty texts and texts without words have an empty set and stay alone; a text with fewer words
than a shingle is one shingle; rows are told apart by an internal number, so repeated ids and rows count as rows, and
`kept` holds for every row whose id is the smallest of its component; a null id is larger than any other, and a
component of null ids alone has a null id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import SALTS, frame, hot_keys, join_back, keep, map_texts, numbered

BANDS, ROWS = 28, 5
LEADERS = 4  # orders by which buckets choose their leaders: a member of a large group meets few of them, not one per band
UNIVERSE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct shingle hashes of many texts at once."""

    def __init__(self, size: int = 3) -> None:
        self.size = size
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word of a byte text: a sum of scrambled numbers of (byte, position in the word)."""
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
        starts, ends = edge[::2], edge[1::2]
        lengths = ends - starts
        inside = np.flatnonzero(~space)
        at = np.arange(len(inside), dtype=np.uint64) - np.repeat((np.cumsum(lengths) - lengths).astype(np.uint64), lengths)
        total = np.r_[np.uint64(0), np.cumsum(mix(self.value[data[inside]] + at * np.uint64(0xD1342543DE82EF95)), dtype=np.uint64)]
        upto = np.cumsum(lengths)
        return starts, mix(total[upto] - total[upto - lengths] + lengths.astype(np.uint64))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's shingles."""
        blobs = [t.encode() for t in texts]
        data = _LOWER[np.frombuffer(b" ".join(blobs) + b" ", np.uint8)]
        bounds = np.cumsum([0, *(len(b) + 1 for b in blobs)])
        starts, hashes = self.words(data)
        upto = np.searchsorted(starts, bounds)
        k = self.size
        joined = hashes.copy()
        for j in range(1, k):
            joined[:-j or None] = mix(joined[:-j or None] * np.uint64(0xD6E8FEB86659FD93) + hashes[j:])
        out = []
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(joined[a:b - k + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for h in hashes[a:b]:
                    short = mix(short * np.uint64(0xA0761D6478BD642F) + h)
                out.append(short)
            else:
                out.append(np.empty(0, np.uint64))
        return out


class Signatures:
    """Circulant MinHash of sets of 64-bit hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> None:
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(UNIVERSE).astype(np.int32)
        turned = rng.permutation(UNIVERSE).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.r_[turned, turned[:bands * rows]], bands * rows)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        at = self.scatter[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        low = np.full(self.bands * self.rows, UNIVERSE, np.int32)
        for i in range(0, len(at), 4096):
            np.minimum(low, self.windows[at[i:i + 4096]].min(axis=0), out=low)
        rows = low.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        return key.view(np.int64)


def summaries(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """`rid, doc_id, n_shingles, d1, d2, bands` of a table `rid, doc_id, text`; d1, d2 are two digests of the set."""

    def make() -> Callable[[list[str]], Iterable[tuple]]:
        shingles, signatures = Shingles(size), Signatures(bands, rows)

        def work(texts: list[str]) -> Iterable[tuple]:
            for hashes in shingles.sets(texts):
                if not len(hashes):
                    yield 0, 0, 0, None
                    continue
                one = mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
                two = mix(hashes + np.uint64(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64)
                yield len(hashes), int(one.view(np.int64)), int(two.view(np.int64)), signatures.keys(hashes).tolist()
        return work

    return map_texts(docs, make, "n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>", 1 << 20)


def verify(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """`a, b, shared, joint` (sizes of intersection and union on the full sets) of pairs `a, b` of row numbers."""
    both = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, set] = {}

        def words(rid: int, text: str) -> set:
            if rid not in last:
                if len(last) > 64:
                    last.clear()
                last[rid] = shingle_set(text, size)
            return last[rid]

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                shared, joint = [], []
                for a, b, ta, tb in zip(part["a"], part["b"], part["ta"], part["tb"]):
                    x, y = words(a, ta), words(b, tb)
                    shared.append(len(x & y))
                    joint.append(len(x) + len(y) - shared[-1])
                yield pa.RecordBatch.from_arrays([pa.array(part["a"], pa.int64()), pa.array(part["b"], pa.int64()),
                                                  pa.array(shared, pa.int64()), pa.array(joint, pa.int64())],
                                                 names=["a", "b", "shared", "joint"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, shared bigint, joint bigint")


_LOWER_MAP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANK = str.maketrans("\t\n\x0b\x0c\r", "     ")


def shingle_set(text: str, size: int = 3) -> set:
    """The exact set of word shingles."""
    words = [w for w in text.translate(_LOWER_MAP | _BLANK).split(" ") if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(size))))


def unequal(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """`rid` of members `rid, rep, hot` of a class whose exact set is not that of its representative.

    A class, or each of the parts of a hot one, passes a task in order, and every text is compared with the first; the
    first ones of the parts of hot classes are then compared with the representative itself.
    """
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("rid"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")
    keys = ["rep", "salt", "rid"]
    sent = (members.select("rep", salt, "rid").join(texts.hint("merge"), "rid").select(*keys, "text")
            .repartition("rep", "salt").sortWithinPartitions(*keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, first, text, words = None, None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows, alike = batch.slice(at, 64).to_pydict(), []
                for rep, part, rid, own in zip(rows["rep"], rows["salt"], rows["rid"], rows["text"]):
                    if (rep, part) != head:
                        head, first, text, words = (rep, part), rid, own, None
                    elif own != text and words is None:
                        words = shingle_set(text, size)
                    alike.append((rep, first, rid, own == text or shingle_set(own, size) == words))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*alike), kinds)],
                                                 names=["rep", "first", "rid", "alike"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    checked = keep(sent.mapInArrow(run, "rep bigint, first bigint, rid bigint, alike boolean"), "near-checked")
    heads = keep(checked.where("rid = first and rid <> rep").select(F.col("rid").alias("a"), F.col("rep").alias("b")), "near-heads")
    if not heads.limit(1).count():
        return checked.where("not alike").select("rid")
    ends = heads.select(F.col("a").alias("rid")).union(heads.select("b")).distinct()
    wrong = (verify(heads, keep(texts.join(ends.hint("merge"), "rid", "left_semi"), "near-head-texts"), size)
             .where("shared <> joint").select(F.col("a").alias("first")))
    behind = checked.join(wrong.hint("merge"), "first", "left_semi")
    return checked.where("not alike").select("rid").union(behind.select("rid")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`rid, comp` with the smallest row number reachable over `a, b`, for rows with links: hooking and pointer jumping.

    Each round gives every row the smallest label beside it and then the label of that label, so the rounds grow with
    the logarithm of a component's diameter. What has changed is counted while a round is written.
    """
    both = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = keep(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.col("rid"), F.min("b")).alias("comp")), "labels")
    while True:
        beside = both.join(labels.select(F.col("rid").alias("b"), "comp").hint("merge"), "b").select(
            F.col("a").alias("rid"), "comp", F.lit(None).cast("bigint").alias("old"))
        hooked = beside.unionByName(labels.withColumn("old", F.col("comp"))).groupBy("rid").agg(
            F.max("old").alias("old"), F.min("comp").alias("mid"))
        jump = hooked.select(F.col("rid").alias("mid"), F.col("mid").alias("far"))
        seen = Observation()
        new = hooked.join(jump.hint("merge"), "mid", "left").select(
            "rid", "old", F.coalesce(F.least("mid", "far"), "mid").alias("comp"))
        labels = keep(new.observe(seen, F.sum(F.when(F.col("old") != F.col("comp"), 1).otherwise(0)).alias("changed"))
                      .select("rid", "comp"), "labels")
        if not seen.get.get("changed"):
            return labels


def relabel(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """`rid, comp` of `nodes`: the label where there is one, else its own number."""
    return nodes.join(labels.hint("merge"), "rid", "left").select("rid", F.coalesce("comp", "rid").alias("comp"))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` of every row; linked where 100 * shared >= percent * joint."""
    source = numbered(frame(docs, id_col, text_col), "near-rows")
    found = near_components(source.select("rid", "text"), size, percent, bands, rows)
    named = keep(source.select("rid", "doc_id").join(found, "rid"), "near-members")
    least = keep(named.groupBy("comp").agg(F.count("*").alias("n"), F.min("doc_id").alias("component_id")).where("n > 1"),
                 "near-least")
    total = least.agg(F.sum("n")).first()[0] or 0
    single = named.join(least, "comp", "left_anti").withColumn("component_id", F.col("doc_id"))
    several = join_back(named, least.drop("n"), ["comp"], hot_keys(least, ["comp"], total))
    return single.select("doc_id", "n_shingles", "component_id").unionByName(
        several.select("doc_id", "n_shingles", "component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_components(source: DataFrame, size: int = 3, percent: int = 85, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """`rid, n_shingles, comp` (smallest row number of the component) of a table `rid, text` with distinct, lasting `rid`."""
    table = keep(summaries(source, size, bands, rows), "near-summaries")
    full = table.where("n_shingles > 0")
    classes = keep(full.groupBy("d1", "d2", "n_shingles").agg(F.count("*").alias("n"), F.min("rid").alias("rep")),
                   "near-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(classes, ["d1", "d2", "n_shingles"], total)
    member = join_back(full.select("rid", "d1", "d2", "n_shingles"), classes.select("d1", "d2", "n_shingles", "n", "rep"),
                       ["d1", "d2", "n_shingles"], hot)
    member = keep(member.select("rid", "n", "rep", F.xxhash64("d1", "d2", "n_shingles").isin(hot).alias("hot")), "near-class-of")
    strays = keep(unequal(member.where("n > 1").select("rid", "rep", "hot"), source.select("rid", "text"), size), "near-strays")
    member = member.select("rid", "rep")
    if strays.limit(1).count():  # equal digests of different sets: such rows stand for themselves
        member = keep(member.join(strays.withColumn("own", F.lit(True)), "rid", "left").select(
            "rid", F.when(F.col("own"), F.col("rid")).otherwise(F.col("rep")).alias("rep")), "near-class-of")
    reps = table.join(member.where("rid = rep").select("rid"), "rid", "left_semi")

    cells = keep(reps.select("rid", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "key")),
                 "near-cells")
    order = F.xxhash64("rid", F.col("band") % LEADERS)
    leaders = keep(cells.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min(F.struct(order.alias("o"), "rid", "size")).alias("lead")).where("n > 1").select(
        "band", "key", "n", F.col("lead.rid").alias("leader"), F.col("lead.size").alias("lead_size")), "near-leaders")
    cell_total = leaders.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(leaders, ["band", "key"], cell_total)
    crowded = keep(join_back(cells, leaders.select("band", "key", "leader", "lead_size"), ["band", "key"], hot),
                   "near-crowded")
    similar = (F.least("size", "lead_size") * 100 >= F.greatest("size", "lead_size") * percent)
    stars = keep(crowded.where((F.col("rid") != F.col("leader")) & similar).select(
        F.least("rid", "leader").alias("a"), F.greatest("rid", "leader").alias("b")).distinct(), "near-stars")
    texts = source.select("rid", "text")
    needed = keep(stars.select(F.col("a").alias("rid")).union(stars.select("b")).distinct(), "near-needed")
    known = keep(verify(stars, keep(texts.join(needed, "rid", "left_semi"), "near-texts"), size), "near-verified")
    linked = F.col("shared") * 100 >= F.col("joint") * percent
    links = known.where(linked).select("a", "b")
    nodes = keep(reps.select("rid"), "near-nodes")
    comps = keep(relabel(nodes, components(links)), "near-components")

    found = open_links(crowded, comps, known, source.select("rid", "text"), table.select("rid", "bands"), size, percent)
    if found.limit(1).count():  # what was found late links whole components: only their labels take part
        ends = comps.select(F.col("rid").alias("a"), F.col("comp").alias("ca")), comps.select(
            F.col("rid").alias("b"), F.col("comp").alias("cb"))
        late = found.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select(
            F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
        labels = components(late).select(F.col("rid").alias("comp"), F.col("comp").alias("least"))
        comps = keep(comps.join(labels, "comp", "left").select("rid", F.coalesce("least", "comp").alias("comp")),
                     "near-components")

    of = member.join(comps.select(F.col("rid").alias("rep"), "comp"), "rep").select("rid", "comp")
    return table.select("rid", "n_shingles").join(of, "rid", "left").select(
        "rid", "n_shingles", F.coalesce("comp", "rid").alias("comp"))


#: Members of a bucket, and shingles of theirs, that are compared with one another at once.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 20


def open_links(crowded: DataFrame, comps: DataFrame, known: DataFrame, texts: DataFrame, bands: DataFrame, size: int,
               percent: int) -> DataFrame:
    """Links `a, b` between members of a bucket that lie in different components.

    Only members outside the largest component of a bucket are compared with the others, inside tasks: pairs are never
    rows, only links are. A pair is looked at in the first band that it shares; sizes too far apart and distances to the
    leader that differ by more than the threshold rule it out. Large buckets are cut into blocks, and each task compares
    two of them.
    """
    placed = crowded.join(comps, "rid")
    counts = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("m"), F.sum("size").alias("shingles"))
    mixed = keep(counts.groupBy("band", "key").agg(
        F.count("*").alias("kinds"), F.sum("m").alias("n"), F.sum("shingles").alias("shingles"),
        F.max(F.struct("m", "comp")).alias("top")).where("kinds > 1").select(
        "band", "key", "n", F.col("top.comp").alias("major"),
        F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias(
            "blocks")), "near-mixed")
    total = mixed.agg(F.sum("n")).first()[0] or 0
    inside = join_back(placed, mixed.select("band", "key", "major", "blocks"), ["band", "key"],
                       hot_keys(mixed, ["band", "key"], total))
    pair = inside.withColumn("a", F.least("rid", "leader")).withColumn("b", F.greatest("rid", "leader"))
    far = 1 - F.col("shared") / F.col("joint")
    inside = keep(pair.join(known.select("a", "b", "shared", "joint").hint("merge"), ["a", "b"], "left").select(
        "band", "key", "rid", "size", "comp", (F.col("comp") != F.col("major")).alias("minor"), "blocks",
        F.when(F.col("rid") == F.col("leader"), 0.0).otherwise(F.coalesce(far, F.lit(-1.0))).alias("far")),
        "near-mixed-members")
    need = keep(inside.select("rid").distinct(), "near-needed")
    facts = keep(texts.join(need.hint("merge"), "rid", "left_semi").join(bands.hint("merge"), "rid"), "near-facts")
    own = F.pmod(F.xxhash64("rid", "band"), F.col("blocks"))
    sent = inside.join(facts.hint("merge"), "rid").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - F.lit(1).cast("bigint"))))
    sent = sent.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                       "rid", "size", "comp", "minor", "far", "bands", "text")
    dealt = sent.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    limit = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        group: list[pa.RecordBatch] = []
        last = None

        def finish() -> Iterator[pa.RecordBatch]:
            if group:
                found = compare(pa.Table.from_batches(group).combine_chunks(), shingles, percent, limit)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                                  pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
                group.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if last is not None and tuple(keys[a]) != last:
                    yield from finish()
                last = tuple(keys[a])
                group.append(batch.slice(a, b - a))
        yield from finish()

    return keep(dealt.mapInArrow(run, "a bigint, b bigint").distinct(), "near-open-links")


def compare(rows: pa.Table, shingles: Shingles, percent: int, limit: float) -> list[tuple[int, int]]:
    """Links between the members of one block or of two; once two components are linked, they count as one."""
    col = {c: rows.column(c).to_numpy() for c in ("own", "rid", "size", "comp", "minor", "far")}
    n, band = len(rows), rows.column("band")[0].as_py()
    within = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    keys = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)[:, :band]
    minor = np.flatnonzero(col["minor"])
    comp = col["comp"].copy()
    sets: dict[int, set] = {}
    texts, words = rows.column("text"), shingles.size

    def members(k: int) -> set:
        if k not in sets:
            sets[k] = set(shingles.sets([texts[k].as_py()])[0].tolist())
        return sets[k]

    found = []
    for x in minor.tolist():
        open_ = (comp != comp[x]) & ((col["own"] != col["own"][x]) | within)
        open_ &= np.minimum(col["size"], col["size"][x]) * 100 >= np.maximum(col["size"], col["size"][x]) * percent
        # two minor members meet once: when the later one in this order is x
        open_ &= ~(col["minor"] & (np.arange(n) > x))
        measured = (col["far"] >= 0) & (col["far"][x] >= 0)
        open_ &= ~measured | (np.abs(col["far"] - col["far"][x]) <= limit)
        open_ &= ~(keys == keys[x]).any(axis=1)
        for y in np.flatnonzero(open_).tolist():
            if comp[x] == comp[y]:
                continue
            a, b = members(x), members(y)
            shared = len(a & b)
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                one, two = shingle_set(texts[x].as_py(), words), shingle_set(texts[y].as_py(), words)
                if 100 * len(one & two) < percent * len(one | two):
                    continue
                rx, ry = int(col["rid"][x]), int(col["rid"][y])
                found.append((min(rx, ry), max(rx, ry)))
                comp[comp == comp[x]] = comp[y]
    return found

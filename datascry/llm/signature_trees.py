"""Exact Jaccard join of documents by word shingles, with trees of signatures inside groups that share a rare shingle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datascry.llm.base import SPACED_WORD, ascii_lower, components, named, written

WORDS = 5
#: A pair links when 100 * shared >= SHARE * united; from it follow the shared shingles a pair needs at least (see needed).
SHARE = 80
#: Shingles that are remembered as frequent, for the order only; 16 bytes each.
FREQUENT = 200_000
#: Shingles that a task holds at most before it counts them; sorting takes a few times their 8 bytes.
HELD_SHINGLES = 1_500_000
#: Rows in one side of a unit of tree work, and links verified beside one text.
UNIT, BESIDE = 1000, 512
#: Hash rows that are broadcast at most when texts are fetched.
BROADCAST_TEXTS = 400_000
FAN = 8


def needed(x, y):
    """Least shared shingles of sets of sizes x and y that link: shared >= SHARE / (100 + SHARE) * (x + y), rounded up."""
    return -(-SHARE * (x + y) // (100 + SHARE))


def shingler(size: int = WORDS, held: int = 150_000):
    """Function from a text to the sorted hashes of its different shingles, 64 bits each."""
    import numpy as np
    import xxhash
    find, lower = re.compile(SPACED_WORD).findall, ascii_lower
    known: dict[str, int] = {}

    class Words(dict):
        def __missing__(self, word):
            if len(self) > held:
                self.clear()
            value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
            return value

    look = Words(known).__getitem__

    def shingles(text):
        words = find(lower(text or ""))
        if not words:
            return np.zeros(0, np.uint64)
        codes = np.fromiter(map(look, words), np.uint64, len(words))
        k = min(size, len(codes))
        total = np.full(len(codes) - k + 1, k, np.uint64)
        for j in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[j:len(codes) - k + 1 + j]
            total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(total ^ (total >> np.uint64(32)))

    return shingles


def frequent_shingles(texts: DataFrame):
    """(sorted hashes, their counts) of shingles that many documents hold. They only decide which shingles come last in the
    order, so a count that misses some tasks' rows changes the cost, never the result."""
    import numpy as np

    def run(batches):
        import pandas as pd
        shingles, parts, size = shingler(), [], 0

        def told():
            every, n = np.unique(np.concatenate(parts), return_counts=True)
            return pd.DataFrame({"h": every[n >= 3].astype(np.int64), "n": n[n >= 3]})

        for batch in batches:
            for text in batch["_text"].tolist():
                parts.append(shingles(text))
                size += len(parts[-1])
                if size > HELD_SHINGLES:
                    yield told()
                    parts, size = [], 0
        if parts:
            yield told()

    rows = texts.select("_text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    hashes = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    place = np.argsort(hashes)
    return hashes[place], top["n"].to_numpy()[place].astype(np.int64)


def signatures(rows: DataFrame, frequent) -> DataFrame:
    """(_id, th, tg, n, digest, bits, keys) of rows(_id, _text, th, tg).

    keys are the first n - ceil(0.8 n) + 1 shingles, rare ones first: two linked sets share one of them. bits is the bitmap of
    all shingles by their low bits, 4 to 8 bits per shingle, so that a wide bitmap folds onto a narrow one.
    """
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        import hashlib

        import numpy as np
        import pandas as pd
        shingles = shingler()
        hashes, counts = sent.value
        for batch in batches:
            out = []
            for text in batch["_text"].tolist():
                found = shingles(text)
                n = len(found)
                if not n:
                    out.append((0, None, None, []))
                    continue
                order = found
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    rank = np.where(hashes[at] == found, counts[at], 0)
                    order = found[np.argsort(rank, kind="stable")]
                out.append((n, hashlib.blake2b(found.tobytes(), digest_size=16).digest(), bitmap(found).tobytes(), order[:n - -(-SHARE * n // 100) + 1].astype(np.int64)))
            done = pd.DataFrame(out, columns=["n", "digest", "bits", "keys"])
            for c in ("_id", "th", "tg"):
                done[c] = batch[c].values
            yield done

    return rows.mapInPandas(run, "_id string, th long, tg long, n long, digest binary, bits binary, keys array<long>")


def bitmap(found):
    """uint64 words of the bitmap of a set of hashes."""
    import numpy as np
    width = 1 << max(6, int(4 * len(found) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(found & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(words, size: int):
    """Bitmap of `size` words from a wider one: halves are united until it fits."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def lacking(x, y) -> int:
    """Shingles of x that y is sure to lack: bits of x that y has not, at the narrower width."""
    import numpy as np
    size = min(x.shape[-1], y.shape[-1])
    return np.bitwise_count(fold(x, size) & ~fold(y, size)).sum(-1)


class Node:
    """A run of items, each one document or one component: all their bits united, the bits they share, and their range of sizes."""

    def __init__(self, first, last, children, any_bits, all_bits, least, most, reach):
        self.first, self.last, self.children = first, last, children
        self.any, self.all, self.least, self.most, self.reach = any_bits, all_bits, least, most, reach


def united(parts, shared: bool):
    import numpy as np
    width = min(len(x) for x in parts)
    return (np.bitwise_and if shared else np.bitwise_or).reduce([fold(x, width) for x in parts])


def grow(items) -> Node:
    """Signature tree of (any bits, all bits, least, most, reach) sorted by size: FAN neighbours below each node, up to one root."""
    level = [Node(k, k + 1, [], *x) for k, x in enumerate(items)]
    while len(level) > 1:
        level = [Node(g[0].first, g[-1].last, g, united([x.any for x in g], False), united([x.all for x in g], True), min(x.least for x in g), max(x.most for x in g), max(x.reach for x in g))
                 for g in (level[k:k + FAN] for k in range(0, len(level), FAN))]
    return level[0]


def apart(a: Node, b: Node) -> bool:
    """No pair of a and b can link: sizes too far apart, or too little possible overlap.

    The largest overlap of x in a with y in b is |x| less the bits that all of a share and none of b has, and no more than
    what follows their common shingle in the order (reach); it must come up to the least that any pair of them needs.
    """
    if 100 * a.most < SHARE * b.least or 100 * b.most < SHARE * a.least:
        return True
    need = needed(a.least, b.least)
    return min(a.reach, b.reach) < need or a.most - lacking(a.all, b.any) < need or b.most - lacking(b.all, a.any) < need


def joined(left, right=None):
    """Pairs (place in left, place in right) of items that may link, by traversing both trees at once; without right, pairs inside left."""
    own, pairs = right is None, []
    root = grow(left)
    stack = [(root, root if own else grow(right))]
    while stack:
        a, b = stack.pop()
        if a is b and own:
            stack += [(a.children[i], a.children[j]) for i in range(len(a.children)) for j in range(i, len(a.children))]
        elif apart(a, b):
            continue
        elif not (a.children or b.children):
            pairs.append((a.first, b.first))
        elif not b.children or (a.children and a.last - a.first >= b.last - b.first):
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, x) for x in b.children]
    return pairs


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets of shingles; texts: (rid, _text).

    The text of a stands before those of its partners, so a task holds one set and one partner. Partners beyond BESIDE are
    dealt to several groups with a copy of a's text each.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("d")).select("a", F.ceil(F.col("d") / BESIDE).cast("int").alias("parts"))
    others = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("rid")).join(texts, "rid")
    heads = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("rid", "a"), "a")
    rows = others.select("a", "part", F.lit(1).alias("kind"), F.col("rid").alias("b"), "_text").unionByName(
        heads.select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "_text"))

    def run(batches):
        import numpy as np
        import pandas as pd
        shingles, head, mine = shingler(), None, None
        for batch in batches:
            out = []
            for a, part, kind, b, text in zip(batch["a"].tolist(), batch["part"].tolist(), batch["kind"].tolist(), batch["b"].tolist(), batch["_text"].tolist()):
                found = shingles(text)
                if kind == 0:
                    head, mine = (a, part), found
                    continue
                if head != (a, part):
                    raise RuntimeError("a pair lacks its first text: the input gave other rows when it was read again")
                at = np.minimum(np.searchsorted(mine, found), len(mine) - 1)
                shared = int((mine[at] == found).sum())
                if 100 * shared >= SHARE * (len(mine) + len(found) - shared):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInPandas(run, "a long, b long")


def texts_of(rows: DataFrame, kinds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rid, _text) of every id in the pairs, written once. rows(_text, th, tg); kinds(rid, th, tg)."""
    wanted = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct().join(kinds.select("rid", "th", "tg"), "rid")
    wanted = written(wanted, "jaccard-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    found = rows.select("_text", "th", "tg").join(wanted, ["th", "tg"]).select("rid", "_text")
    return written(found.dropDuplicates(["rid"]), "jaccard-texts")


def component_nodes(kinds: DataFrame) -> DataFrame:
    """(comp, any, all): the united and the shared bits of each component; kinds: (rid, comp, bits). Combined in parts first."""

    def run(frame):
        import numpy as np
        import pandas as pd
        every = [np.frombuffer(x, np.uint64) for x in frame["any"]]
        shared = [np.frombuffer(x, np.uint64) for x in frame["all"]]
        return pd.DataFrame({"comp": [frame["comp"].iloc[0]], "any": [united(every, False).tobytes()], "all": [united(shared, True).tobytes()]})

    schema = "comp long, any binary, all binary"
    sizes = kinds.groupBy("comp").agg(F.count("*").alias("size"))
    rows = kinds.join(sizes, "comp").select("comp", "size", F.col("bits").alias("any"), F.col("bits").alias("all"), F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / UNIT)).alias("part"))
    one = rows.where("size = 1").select("comp", "any", "all")
    parts = rows.where("size > 1").select("comp", "part", "any", "all").groupBy("comp", "part").applyInPandas(run, schema)
    return one.unionByName(parts.groupBy("comp").applyInPandas(run, schema)).join(sizes, "comp")


def near_components(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) components that share a group and that the signature trees cannot tell apart. members: (key, comp, n, pos).

    A component is one item of a group's tree, whatever its size. Groups of the same components are traversed once. Groups
    beyond UNIT items are cut into blocks along the sizes; blocks whose sizes can link meet in units of their own.
    """
    items = members.groupBy("key", "comp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("reach"))
    names = items.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("comp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "comp")).alias("y")).where("m > 1")
    items = items.join(names, "key").groupBy("m", "x", "y", "comp").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("reach").alias("reach"))
    items = items.withColumn("key", F.xxhash64("m", "x", "y"))
    order = Window.partitionBy("key").orderBy("low", "comp")
    rows = written(items.select("key", "comp", "low", "high", "reach", F.floor((F.row_number().over(order) - 1) / UNIT).cast("int").alias("block")), "tree-items")
    ranges = rows.groupBy("key", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    second = ranges.select("key", F.col("block").alias("other"), F.col("low").alias("other_low"))
    units = ranges.join(second, "key").where((F.col("block") <= F.col("other")) & (100 * F.col("high") >= SHARE * F.col("other_low"))).select("key", "block", "other")
    sides = units.select("key", "block", "other", F.col("block").alias("mine"), F.lit(0).alias("side")).unionByName(
        units.where("block < other").select("key", "block", "other", F.col("other").alias("mine"), F.lit(1).alias("side")))
    work = rows.join(nodes.select("comp", "any", "all"), "comp").withColumnRenamed("block", "mine").join(sides, ["key", "mine"]).drop("mine")

    def traverse(frame):
        left, right = frame[frame["side"] == 0].sort_values(["low", "comp"]), frame[frame["side"] == 1].sort_values(["low", "comp"])
        pairs = joined(tree_items(left), tree_items(right) if len(right) else None)
        right = right if len(right) else left
        a, b = left["comp"].to_numpy(), right["comp"].to_numpy()
        return [(min(a[i], b[j]), max(a[i], b[j])) for i, j in pairs]

    return in_groups(work, ["key", "block", "other"], traverse).distinct()


def tree_items(frame):
    import numpy as np
    return [(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), low, high, reach) for p, q, low, high, reach in
            zip(frame["any"], frame["all"], frame["low"].tolist(), frame["high"].tolist(), frame["reach"].tolist())]


def in_groups(work: DataFrame, keys: list[str], traverse) -> DataFrame:
    """(a, b) from traverse(rows of one group), for all groups; rows are sorted by the keys, a task holds one group at a time."""

    def run(batches):
        import numpy as np
        import pandas as pd
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            codes = [held[k].to_numpy() for k in keys]
            changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
            out = []
            for a, b in zip([0, *changes[:-1]], changes):
                out += traverse(held.iloc[a:b])
            held = held.iloc[changes[-1]:].reset_index(drop=True) if len(changes) else held
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if held is not None and len(held):
            yield pd.DataFrame(traverse(held), columns=["a", "b"], dtype="int64")

    return work.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def member_pairs(near: DataFrame, kinds: DataFrame) -> DataFrame:
    """(a, b) documents of components that may link. near: (a, b) components; kinds: (rid, comp, n, bits).

    The members of the larger component stand in blocks, those of all smaller ones beside it are dealt to chunks; each block
    meets each chunk once, so a large component is not repeated for every other one.
    """
    sizes = kinds.groupBy("comp").agg(F.count("*").alias("size"))
    sized = near.join(sizes.select(F.col("comp").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("comp").alias("b"), F.col("size").alias("sb")), "b")
    swap = F.col("sb") > F.col("sa")
    sized = sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("large"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("comp"), F.greatest("sa", "sb").alias("size"))
    visitors = sized.join(kinds.select("comp", "rid"), "comp").select("large", "size", "rid").distinct()
    counts = visitors.groupBy("large").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("chunks"), F.ceil(F.max("size") / UNIT).cast("int").alias("blocks"))
    place = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    hosts = kinds.select(F.col("comp").alias("large"), "rid").join(counts, "large")
    hosts = hosts.select("large", place("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "rid", F.lit(0).alias("side"))
    guests = visitors.join(counts, "large")
    guests = guests.select("large", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), place("chunks").alias("chunk"), "rid", F.lit(1).alias("side"))
    facts = kinds.select("rid", F.col("bits").alias("any"), F.col("bits").alias("all"), F.col("n").alias("low"), F.col("n").alias("high"), F.col("n").alias("reach"))
    work = hosts.unionByName(guests).join(facts, "rid")

    def traverse(frame):
        left, right = frame[frame["side"] == 0].sort_values(["low", "rid"]), frame[frame["side"] == 1].sort_values(["low", "rid"])
        if not (len(left) and len(right)):
            return []
        a, b = left["rid"].to_numpy(), right["rid"].to_numpy()
        return [(min(a[i], b[j]), max(a[i], b[j])) for i, j in joined(tree_items(left), tree_items(right))]

    return in_groups(work, ["large", "block", "chunk"], traverse).distinct()


def still_open(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, rid, n, pos, comp) of the groups whose classes are in several components."""
    with_comp = groups.join(comps.withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    several = with_comp.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return written(with_comp.join(several, "key"), "open-members")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, _th (hash of the text): components of documents whose shingle sets link.

    A set holds the different runs of five words (all words of a shorter text), words without ASCII white space, A-Z
    lower-cased. Two documents link when 100 * shared >= 80 * united. component_id is the smallest id reachable by links.

    1. Documents with equal sets are one class, of one row. 2. Every class gives its rarest shingles, as many as any linked
    class must share one of; a group is the classes that give the same one. 3. In each group one class is compared with all
    others, then in those still open the class that is in most of them; the links make first components, so large groups of
    copies cost a comparison or two a copy. 4. In groups that still
    hold several components, signature trees are traversed against each other and pairs of different components that can
    overlap enough are verified. No link between different components is missed: a linked pair shares a group, and there it
    is either in one component already or its bounds let it through to the comparison of whole sets.
    Shingles are compared by 64-bit hashes.

    Null, empty and blank texts have no shingles and link with nothing. A null id never names a component unless all of its
    rows have none; repeated rows return as they stand; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("th"), F.xxhash64(F.lit(1), text_col).alias("tg"))
    signed = written(signatures(rows, frequent_shingles(rows)), "signatures")
    classes = signed.where("n > 0").groupBy("digest").agg(
        F.min(F.col("_id").cast(kind)).alias("low"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"), F.min(F.struct("th", "tg")).alias("t"))
    classes = written(classes.select("digest", "low", "n", "bits", "keys", "t.th", "t.tg", F.monotonically_increasing_id().alias("rid")), "classes")

    keyed = classes.select("rid", "n", F.posexplode("keys").alias("pos", "key")).select("key", "rid", F.col("n").cast("int").alias("n"), "pos")
    first = Window.partitionBy("key").orderBy(F.xxhash64("rid"), "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    centres = [F.first(c).over(first).alias(f"c{c}") for c in ("rid", "n", "pos")]
    groups = written(keyed.select("key", "rid", "n", "pos", *centres).where("rid <> crid"), "shingle-groups")

    size_fits = (100 * F.least("n", "cn") >= SHARE * F.greatest("n", "cn"))
    fits = size_fits & (F.least(F.col("n") - F.col("pos"), F.col("cn") - F.col("cpos")) * (100 + SHARE) >= SHARE * (F.col("n") + F.col("cn")))
    stars = groups.where(fits).select(F.col("crid").alias("a"), F.col("rid").alias("b"), F.col("cn").alias("na"), F.col("n").alias("nb")).distinct()
    stars = written(possible(stars, classes), "star-pairs")
    links = written(verified(stars, texts_of(rows, classes, stars)), "star-links")
    comps = components(links)

    # the centre has met all others of its group; what is left are pairs of the others from different components
    inside = still_open(groups.select("key", "rid", "n", "pos"), comps)
    # a second centre per group: the class that is in most open groups, as the original of many copies is
    often = inside.groupBy("rid").agg(F.count("*").alias("often"))
    second = Window.partitionBy("key").orderBy(F.desc("often"), "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = inside.join(often, "rid").select("key", "rid", "n", "pos", "comp", *[F.first(c).over(second).alias(f"c{c}") for c in ("rid", "n", "pos", "comp")])
    stars = again.where((F.col("comp") != F.col("ccomp")) & fits).select(F.col("crid").alias("a"), F.col("rid").alias("b"), F.col("cn").alias("na"), F.col("n").alias("nb")).distinct()
    stars = written(possible(stars, classes), "second-star-pairs")
    links = written(links.unionByName(verified(stars, texts_of(rows, classes, stars))), "both-star-links")
    comps = components(links)
    inside = still_open(again.where("rid <> crid").select("key", "rid", "n", "pos"), comps)
    own = comps.select(F.col("id").alias("rid"), "comp")
    shown = inside.select("comp").distinct()
    kinds = classes.select("rid", "n", "bits").join(own, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")).join(shown, "comp", "leftsemi")
    kinds = written(kinds.select("rid", "comp", "n", "bits"), "open-kinds")
    near = written(near_components(inside, component_nodes(kinds)), "near-components")
    more = written(member_pairs(near, kinds), "tree-pairs")
    late = verified(more, texts_of(rows, classes, more))
    comps = components(links.unionByName(late))

    merged = classes.select("digest", "rid", "low").join(comps.withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    lows = merged.groupBy("comp").agg(F.min("low").alias("component_id"))
    named_classes = merged.join(lows, "comp").select("digest", "component_id")
    out = signed.select("_id", "th", "n", "digest").join(named_classes, "digest", "left")
    out = out.select("_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id").cast(kind)).alias("component_id"), F.col("th").alias("_th"))
    return named(out, id_col, kind)


def possible(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose bitmaps leave enough possible overlap."""
    bits = kinds.select("rid", "bits")
    rows = pairs.join(bits.select(F.col("rid").alias("a"), F.col("bits").alias("abits")), "a").join(bits.select(F.col("rid").alias("b"), F.col("bits").alias("bbits")), "b")

    def run(batches):
        import numpy as np
        import pandas as pd
        for batch in batches:
            out = []
            for a, b, x, y, p, q in zip(*(batch[c].tolist() for c in ("a", "b", "na", "nb", "abits", "bbits"))):
                p, q, need = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), needed(x, y)
                if x - lacking(p, q) >= need and y - lacking(q, p) >= need:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(run, "a long, b long")

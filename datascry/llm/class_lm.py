"""Class-based word model: exchange clustering puts words into classes; transitions of classes and words within classes score text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import SPACED_WORD, ascii_lower, named, short_batches, written
from datascry.llm.blocks import BLOCK_BYTES, answered, in_blocks

#: The word that ends each document. No word of a text is empty.
END = ""


def word_counts(docs: DataFrame, text_col: str, held: int = 200_000) -> DataFrame:
    """(word, c): occurrences over all texts, with one END per row. Counted inside the tasks first; a task holds at most `held` words."""

    def run(batches):
        from collections import Counter

        import pandas as pd
        find, lower = re.compile(SPACED_WORD).findall, ascii_lower
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["_text"].tolist():
                counts.update(find(lower(text or "")))
                counts[END] += 1
                if len(counts) > held:
                    yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})
                    counts.clear()
        yield pd.DataFrame({"word": list(counts), "c": list(counts.values())}).astype({"word": object, "c": "int64"})

    rows = docs.select(F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class UnitFinder(dict):
    """From a word to its unit: a frequent word is its own unit, the others share units by their last three letters. Remembers `held` words."""

    def __init__(self, top: dict[str, int], buckets: int, held: int = 200_000):
        super().__init__(top)
        self.top, self.buckets, self.held = top, buckets, held

    def __missing__(self, word: str) -> int:
        import zlib
        if len(self) > self.held:
            self.clear()
            self.update(self.top)
        found = self[word] = len(self.top) + zlib.crc32(word[-3:].encode()) % self.buckets
        return found


def unit_pairs(docs: DataFrame, text_col: str, top: dict[str, int], buckets: int) -> DataFrame:
    """(u1, u2, n): neighbouring units over all texts; END stands before the first and after the last word."""
    spark, units = docs.sparkSession, len(top) + buckets
    sent = spark.sparkContext.broadcast(top)

    def run(batches):
        import numpy as np
        import pandas as pd
        find, lower, unit = re.compile(SPACED_WORD).findall, ascii_lower, UnitFinder(sent.value, buckets).__getitem__
        end, parts, size = unit(END), [], 0
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged():
            fresh, n = np.unique(np.concatenate(parts), return_counts=True)
            every, back = np.unique(np.concatenate([codes, fresh]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, back, np.concatenate([counts, n]))
            return every, total

        for batch in batches:
            for text in batch["_text"].tolist():
                found = find(lower(text or ""))
                line = np.empty(len(found) + 2, np.int64)
                line[0] = line[-1] = end
                line[1:-1] = np.fromiter(map(unit, found), np.int64, len(found))
                parts.append(line[:-1] * units + line[1:])
                size += len(line)
                if size > 2_000_000:
                    codes, counts = merged()
                    parts, size = [], 0
        if parts:
            codes, counts = merged()
        yield pd.DataFrame({"code": codes, "n": counts})

    rows = docs.select(F.col(text_col).alias("_text")).mapInPandas(run, "code long, n long")
    rows = rows.groupBy("code").agg(F.sum("n").alias("n"))
    return rows.select(F.floor(F.col("code") / units).cast("int").alias("u1"), (F.col("code") % units).cast("int").alias("u2"), "n")


def exchange(contexts, matrix, classes):
    """Move each unit of `contexts` to the class that raises the likelihood most; returns {unit: class}.

    contexts: unit, klass, after, before, same: how often the unit stands before and after words of each class, and before
    itself. matrix: counts of class pairs; it follows the moves made here.
    """
    import numpy as np

    def xlogx(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    def likelihood(m):
        return xlogx(m).sum((-2, -1)) - xlogx(m.sum(-1)).sum(-1) - xlogx(m.sum(-2)).sum(-1)

    k, matrix, out = len(matrix), matrix.astype(float).copy(), {}
    each = np.arange(k)
    for unit, rows in contexts.groupby("unit", sort=True):
        now = int(classes[unit])
        after, before = np.zeros(k), np.zeros(k)
        np.add.at(after, rows["klass"].to_numpy(), rows["after"].to_numpy())
        np.add.at(before, rows["klass"].to_numpy(), rows["before"].to_numpy())
        same = float(rows["same"].sum())
        without = matrix.copy()
        without[now, :] -= after
        without[:, now] -= before
        without[now, now] += same
        after[now] -= same
        before[now] -= same
        tried = np.repeat(without[None], k, axis=0)
        tried[each, each, :] += after
        tried[each, :, each] += before
        tried[each, each, each] += same
        gains = likelihood(tried)
        best = int(gains.argmax())
        if gains[best] <= gains[now] + 1e-9:
            best = now
        out[int(unit)], matrix = best, tried[best]
    return out


def mover(matrix, classes):
    def move(rows):
        import pandas as pd
        return pd.DataFrame(list(exchange(rows, matrix, classes).items()), columns=["unit", "klass"])

    return move


def cluster_units(pairs: DataFrame, n_units: int, n_classes: int, rounds: int, shards: int = 8):
    """(class of each unit, counts of class pairs) after exchange rounds over the pair table.

    A round sums each unit's contexts by class, and the units of a shard try every class in turn against the exact
    likelihood, the others held; a round that lowers the likelihood is undone and ends the search. The driver holds one class
    per unit and the matrix of classes, both of fixed size.
    """
    import numpy as np
    import pandas as pd
    spark = pairs.sparkSession
    classes = np.arange(n_units) % n_classes
    best, best_matrix, highest = classes, np.zeros((n_classes, n_classes)), -np.inf
    for number in range(rounds + 1):
        table = spark.createDataFrame(pd.DataFrame({"unit": np.arange(n_units), "klass": classes}), "unit int, klass int")
        first = F.broadcast(table.select(F.col("unit").alias("u1"), F.col("klass").alias("k1")))
        second = F.broadcast(table.select(F.col("unit").alias("u2"), F.col("klass").alias("k2")))
        known = pairs.join(first, "u1").join(second, "u2")
        matrix = np.zeros((n_classes, n_classes))
        for row in known.groupBy("k1", "k2").agg(F.sum("n").alias("n")).collect():
            matrix[row.k1, row.k2] = row.n
        reached = likelihood_of(matrix)
        if reached <= highest:
            break
        best, best_matrix, highest = classes, matrix, reached
        if number == rounds:
            break
        same = F.when(F.col("u1") == F.col("u2"), F.col("n")).otherwise(0)
        contexts = known.select(F.col("u1").alias("unit"), F.col("k2").alias("klass"), F.col("n").alias("after"), F.lit(0).cast("long").alias("before"), same.cast("long").alias("same")).unionByName(
            known.select(F.col("u2").alias("unit"), F.col("k1").alias("klass"), F.lit(0).cast("long").alias("after"), F.col("n").alias("before"), F.lit(0).cast("long").alias("same")))
        contexts = contexts.groupBy("unit", "klass").agg(*[F.sum(c).alias(c) for c in ("after", "before", "same")])
        moves = contexts.withColumn("shard", F.col("unit") % shards).groupBy("shard").applyInPandas(mover(matrix, classes), "unit int, klass int").collect()
        classes = classes.copy()
        for row in moves:
            classes[row.unit] = row.klass
    return best, best_matrix


def best_classes(after, before, same, now, matrix):
    """The class of each word that raises the likelihood most, every other word held; words side by side, as `exchange` does for one.

    after, before: (words, classes) how often a word stands before and after words of each class, same: before itself; now: its
    class. matrix: counts of class pairs. A move changes one row and one column of the matrix, and in them only where the word
    has neighbours, so the exact difference is a sum over those.
    """
    import numpy as np

    def xlogx(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    n, k = after.shape
    each, words, matrix = np.arange(k), np.arange(n), matrix.astype(float)
    after, before, same = after.astype(float), before.astype(float), same.astype(float)
    after[words, now] -= same
    before[words, now] -= same
    count, mine = after.sum(1) + same, each[None, :] == now[:, None]
    gains = np.zeros((n, k))
    for sums, size in ((matrix.sum(1), count), (matrix.sum(0), before.sum(1) + same)):
        left = sums[None, :] - mine * size[:, None]
        gains -= xlogx(left + size[:, None]) - xlogx(left)
    for own, other, table in ((after, before, matrix), (before, after, matrix.T)):
        w, d = np.nonzero(own)
        v = own[w, d][:, None]
        left = table[:, d].T - mine[w] * v - (now[w] == d)[:, None] * other[w]
        change = np.where(each[None, :] == d[:, None], 0.0, xlogx(left + v) - xlogx(left))
        if len(w):
            met, begin = np.unique(w, return_index=True)
            gains[met] += np.add.reduceat(change, begin, axis=0)
    met = after + before + same[:, None]
    left = matrix.diagonal()[None, :] - mine * met
    gains += xlogx(left + met) - xlogx(left)
    best = gains.argmax(1)
    return np.where(gains[words, best] > gains[words, now] + 1e-9, best, now)


def asked_words(blocked: DataFrame, top: dict[str, int], buckets: int, classes, n_classes: int, held: int = 500_000) -> DataFrame:
    """(_block, word, contexts): the words of each block that are not in `top`, with what stands beside them in its training texts.

    contexts: n * (2 * n_classes + 1) + code; n words of class `code` stand behind the word, of class `code - n_classes`
    before it, or (the last code) the word itself stands behind it. A block's words come more than once where there are over `held`.
    """
    sent, width = blocked.sparkSession.sparkContext.broadcast((top, classes)), 2 * n_classes + 1

    class Places(dict):
        def __init__(self, known, unit, classes):
            super().__init__(known)
            self.unit, self.classes, self.klass, self.parts, self.size = unit, classes, [int(classes[u]) for u in known.values()], [], 0

        def __missing__(self, word):
            place = self[word] = len(self)
            self.klass.append(int(self.classes[self.unit(word)]))
            return place

    def run(batches):
        import numpy as np
        import pyarrow as pa
        common, classes = sent.value
        find, lower, unit = re.compile(SPACED_WORD).findall, ascii_lower, UnitFinder(common, buckets, held=50_000).__getitem__
        blocks: dict[int, Places] = {}

        def counted(found):
            codes, n = (np.concatenate(x) for x in zip(*found.parts))
            order = np.argsort(codes)
            codes, n = codes[order], n[order]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            found.parts = [(codes[first], np.add.reduceat(n, first))]
            found.size = len(first)

        def told(block):
            found = blocks.pop(block)
            words, n_words = list(found)[len(common):], len(found) - len(common)
            codes = n = np.zeros(0, np.int64)
            if found.size:
                counted(found)
                codes, n = found.parts[0]
            offsets = np.searchsorted(codes // width, np.arange(len(common), len(found) + 1))
            contexts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(n * width + codes % width, pa.int32()))
            for k in range(0, n_words, 10_000):
                size = min(10_000, n_words - k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block), pa.int32()), pa.array(words[k:k + size], pa.string()), contexts.slice(k, size)], names=["_block", "word", "contexts"])

        for batch in batches:
            lines: dict[int, list] = {}
            for block, text, is_held in zip(*(batch.column(c).to_pylist() for c in ("_block", "_text", "_held"))):
                found = blocks.get(block)
                if found is None:
                    found = blocks[block] = Places(common, unit, classes)
                words = find(lower(text or ""))
                line = np.fromiter(map(found.__getitem__, words), np.int64, len(words))
                if not is_held:
                    lines.setdefault(block, [[found[END]]]).extend((line, [found[END]]))
            for block, parts in lines.items():
                found, line = blocks[block], np.concatenate(parts).astype(np.int64)  # the end of one text stands before the next
                klass = np.array(found.klass)[line]
                left, right = line[:-1], line[1:]
                codes = [left * width + klass[1:], right * width + n_classes + klass[:-1], (left * width + width - 1)[left == right]]
                codes = np.concatenate(codes)
                codes, n = np.unique(codes[codes >= len(common) * width], return_counts=True)
                found.parts.append((codes, n))
                found.size += len(codes)
                if found.size > 1_000_000:
                    counted(found)
            for block in [b for b, found in blocks.items() if len(found) > held]:
                yield from told(block)
        for block in list(blocks):
            yield from told(block)

    return blocked.select("_block", "_text", "_held").mapInArrow(run, "_block int, word string, contexts array<int>")


def with_moves(matrix, after, before, same, now, then, times: int):
    """The matrix after words went from class `now` to `then`, as if `times` as many of their kind had."""
    import numpy as np
    change = np.zeros(matrix.shape)
    words = np.flatnonzero(now != then)
    a, b, same = after[words].astype(float), before[words].astype(float), same[words]
    old, new = now[words], then[words]
    at = np.arange(len(words))
    a[at, old] -= same
    b[at, old] -= same
    for klass, sign in ((old, -1), (new, 1)):
        np.add.at(change, klass, sign * a)
        np.add.at(change.T, klass, sign * b)
        np.add.at(change, (klass, klass), sign * same)
    return np.maximum(matrix + times * change, 0.0)


def moved_words(asked: DataFrame, top: dict[str, int], buckets: int, classes, matrix, moving: bool, shards: int, step: int = 500) -> DataFrame:
    """(_block, word, c, klass): count and class of every asked word that stands in training texts, for each block that asks for it.

    With `moving` each word goes to the class that its contexts of all blocks make likeliest, else it keeps that of its unit.
    Words are dealt to `shards` tasks by hash. A task moves `step` words at a time and its matrix follows them, the moves
    counted once for each shard: the others have words of the same kinds and move them as well.
    """
    n_classes = len(matrix)
    sent, width = asked.sparkSession.sparkContext.broadcast((top, classes, matrix)), 2 * n_classes + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa
        common, classes, matrix = sent.value
        unit = UnitFinder(common, buckets, held=0).__missing__
        for batch in batches:
            n_words, lists = batch.num_rows, batch.column("contexts")
            values, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n_words), np.diff(lists.offsets.to_numpy()))
            seen = np.zeros((n_words, width))
            np.add.at(seen, (owner, values % width), values // width)
            after, before, same = seen[:, :n_classes], seen[:, n_classes:-1], seen[:, -1]
            klass = classes[np.array([unit(w) for w in batch.column("word").to_pylist()], np.int64)]
            for k in range(0, n_words if moving else 0, step):
                part = slice(k, k + step)
                best = best_classes(after[part], before[part], same[part], klass[part], matrix)
                matrix, klass[part] = with_moves(matrix, after[part], before[part], same[part], klass[part], best, shards), best
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("blocks"), pa.array(after.sum(1).astype(np.int64)), pa.array(klass, pa.int32())], names=["word", "blocks", "c", "klass"])

    words = asked.repartition(shards, "word").groupBy("word").agg(F.array_distinct(F.collect_list("_block")).alias("blocks"), F.flatten(F.collect_list("contexts")).alias("contexts"))
    words = words.mapInArrow(run, "word string, blocks array<int>, c long, klass int").where("c > 0")
    return words.select(F.explode("blocks").alias("_block"), "word", "c", "klass")


def class_pairs(coded: DataFrame, n_classes: int, end_class: int):
    """Counts of class pairs over the training texts of coded(_held, klass)."""
    import numpy as np

    def run(batches):
        import pandas as pd
        total = np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            for klass in batch["klass"].tolist():
                k = np.asarray(klass, np.int64)
                total += np.bincount(np.r_[end_class, k[:-1]] * n_classes + k, minlength=len(total))
        yield pd.DataFrame({"code": np.arange(len(total)), "n": total})

    matrix = np.zeros(n_classes * n_classes)
    for row in coded.where("not _held").select("klass").mapInPandas(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        matrix[row.code] = row.n
    return matrix.reshape(n_classes, n_classes)


def likelihood_of(matrix) -> float:
    """What the classes add to the log likelihood of the training texts."""
    import numpy as np
    log = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0).sum()
    return float(log(matrix) - log(matrix.sum(0)) - log(matrix.sum(1)))


def score_class_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, top_words: int = 1024,
                   buckets: int = 512, n_classes: int = 24, rounds: int = 4, weight: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are runs without ASCII white space, A-Z lower-cased; each text has one end token. Rows whose crc32 of the id as
    text modulo `folds` is `held_fold` are held out; all others train (a null id trains). Every known word has a class of its
    own: rounds of exchange cluster the `top_words` most frequent words singly beside `buckets` units of the others, by their
    last three letters; then every other word, whatever its count, leaves its unit for the class that its own neighbours make
    likeliest. Were the likelihood lower after that, as all of them move at once, the words would stay with their units.
    P(w | v) = weight * P(class(w) | class(v)) * c(w) / c(class(w)) + (1 - weight) * (c(w) + 1) / (N + V + 1); transitions
    are counted again over the final classes and smoothed with the class shares. The words are a sharded table; blocks of
    texts tell it what stands beside their words and fetch counts and classes from it.
    Null and empty texts have the end token only; without any training row every score comes from the base formula with
    N = V = 0; repeated rows count and return as they stand; other columns are ignored; an empty table gives no rows.
    """
    import numpy as np
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    held = F.coalesce(F.crc32(F.col("_id").cast("binary")) % folds == held_fold, F.lit(False))
    rows = rows.withColumn("_held", held)
    train = rows.where(~F.col("_held"))
    counts = written(word_counts(train, "_text"), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top_counts = {x.word: x.c for x in counts.orderBy(F.desc("c"), "word").limit(top_words).collect()}
    top_counts.setdefault(END, counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    top = {word: k for k, word in enumerate(top_counts)}
    n_units = len(top) + buckets
    if total:
        pairs = written(unit_pairs(train, "_text", top, buckets), "unit-pairs")
        classes, first = cluster_units(pairs, n_units, n_classes, rounds)
    else:
        classes, first = np.zeros(n_units, int), np.zeros((n_classes, n_classes))
    sent = spark.sparkContext.broadcast((top, top_counts, classes))

    def encode(frame, found):
        from itertools import repeat

        import pandas as pd
        common, common_counts, classes = sent.value
        find, lower, unit = re.compile(SPACED_WORD).findall, ascii_lower, UnitFinder(common, buckets, held=50_000).__getitem__
        place = dict(common)
        place.update(zip(found["word"].tolist(), range(len(place), len(place) + len(found))))
        first = len(common) + len(found)  # behind the known words those that training lacks: their unit stands for them
        c = np.concatenate([np.fromiter(common_counts.values(), np.int64, len(common)), found["c"].to_numpy(np.int64), np.zeros(buckets, np.int64)])
        klass = np.concatenate([classes[:len(common)], found["klass"].to_numpy(np.int64), classes[len(common):]]).astype(np.int32)
        base = np.log10((c + 1) / (total + distinct + 1))
        out = []
        for key, text, is_held in zip(frame["_id"].tolist(), frame["_text"].tolist(), frame["_held"].tolist()):
            words = find(lower(text or ""))
            at = np.full(len(words) + 1, place[END])
            at[:-1] = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
            for k in np.flatnonzero(at < 0).tolist():
                at[k] = first + unit(words[k]) - len(common)
            out.append((key, is_held, int((c[at] > 0).sum()), float(base[at].sum()), klass[at], c[at]))
        return pd.DataFrame(out, columns=["_id", "_held", "n_known", "base_score", "klass", "c"])

    def coded(moving):
        blocked = in_blocks(rows, "_text", block_bytes)
        words = moved_words(asked_words(blocked, top, buckets, classes, n_classes), top, buckets, classes, first, moving, max(8, -(-distinct // 50_000)))
        return written(answered(blocked, words, encode, "_id string, _held boolean, n_known long, base_score double, klass array<int>, c array<long>"), "coded-texts")

    texts, end_class = coded(bool(total)), int(classes[top[END]])
    matrix = class_pairs(texts, n_classes, end_class)
    if likelihood_of(matrix) < likelihood_of(first):
        texts, matrix = coded(False), first
    share = (matrix.sum(0) + 1e-9) / (matrix.sum() + 1e-9 * n_classes)
    transitions, sizes = (matrix + 5.0 * share) / (matrix.sum(1, keepdims=True) + 5.0), matrix.sum(0)

    def score(batches):
        import pandas as pd
        for batch in batches:
            out = []
            for key, is_held, n_known, base, k, c in zip(*(batch[x].tolist() for x in ("_id", "_held", "n_known", "base_score", "klass", "c"))):
                k, c = np.asarray(k, np.int64), np.asarray(c, float)
                within = np.where(sizes[k] > 0, c / np.maximum(sizes[k], 1), 0)
                p = weight * transitions[np.r_[end_class, k[:-1]], k] * within + (1 - weight) * (c + 1) / (total + distinct + 1)
                value = float(np.log10(p).sum()) if total else base
                out.append((key, is_held, len(k), n_known, total, base, value, 10 ** min(300.0, -value / len(k))))
            yield pd.DataFrame(out, columns=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = "_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return named(texts.mapInPandas(score, schema), id_col, kind)

"""Benchmark decontamination: windows of benchmark words in a broadcast hash set, scanned over every document."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import PLAIN_WORD, ascii_lower, named, written

#: Benchmark text that is broadcast at once, in bytes. A larger benchmark is scanned in several slices of this size.
SLICE_BYTES = 32 << 20


def window_index(items, size: int):
    """(ids of words, sorted window hashes per window length, windows per hash) of (item, text) pairs.

    A window is a tuple of word ids; the dict from windows to items settles every hit of the hashes, so a hash that two
    windows share does no harm.
    """
    import numpy as np
    find, lower = re.compile(PLAIN_WORD).findall, ascii_lower
    words: dict[str, int] = {}
    windows: dict[tuple, list] = {}
    for item, text in items:
        ids = [words.setdefault(w, len(words) + 1) for w in find(lower(text or ""))]
        length = min(size, len(ids))
        for start in range(len(ids) - length + 1) if length else ():
            owners = windows.setdefault(tuple(ids[start:start + length]), [])
            if item not in owners:
                owners.append(item)
    by_length: dict[int, list] = {}
    for window in windows:
        by_length.setdefault(len(window), []).append(window)
    hashes = {n: np.unique(rolling(np.array(group, dtype=np.uint64).reshape(-1), n)[::n]) for n, group in by_length.items()}
    return words, hashes, windows


def rolling(ids, size: int):
    """Hash of each run of `size` ids: a polynomial modulo 2^64 over mixed ids."""
    import numpy as np
    mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) ^ (ids >> np.uint64(7))
    total = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x100000001B3) + mixed[k:len(ids) - size + 1 + k]
    return total


def scan_text(text, find, lower, index):
    """(words of the text, marks of the words inside a window, items with a window in the text)."""
    import numpy as np
    words, hashes, windows = index
    found = find(lower(text or ""))
    ids = np.fromiter(map(words.get, found, (0,) * len(found)), dtype=np.uint64, count=len(found))
    marks, items = np.zeros(len(found) + 1, dtype=np.int64), set()
    for size, known in hashes.items():
        if len(ids) < size:
            continue
        outside = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(ids == 0, out=outside[1:])
        starts = np.nonzero(outside[size:] == outside[:len(ids) - size + 1])[0]  # no word that the benchmark lacks
        if not len(starts):
            continue
        mine = rolling(ids, size)[starts]
        near = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        for start in starts[known[near] == mine].tolist():
            owners = windows.get(tuple(ids[start:start + size].tolist()))
            if owners:
                marks[start] += 1
                marks[start + size] -= 1
                items.update(owners)
    return found, np.cumsum(marks[:-1]) > 0, items


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = 13, one_in: int = 20, slice_bytes: int = SLICE_BYTES, keep_text: bool = False) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, spans array<struct<from, to>>; with `keep_text`, clean_text.

    Words are runs of ASCII letters and digits and all letters beyond ASCII, A-Z lower-cased. A window is `size` consecutive
    words of an item, or all words of a shorter one. A document word inside an occurring window is hit; the document is
    contaminated when a word is hit and at least one in `one_in` words is. `spans` are the hit runs as code-point ranges;
    clean_text is the text without them.

    The benchmark is broadcast where its text is within `slice_bytes` (counted first); a larger one is split by item into
    slices of that size, each is scanned over all documents, and marks of all slices are united per document.
    Null or empty text has no words and is clean; an empty benchmark hits nothing; items that are null are named "null";
    repeated items and rows count as they stand (items once); ids may repeat or be null; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    test = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text")).distinct()
    total = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-2 * total // slice_bytes)) if total > slice_bytes else 1
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    schema = "_id string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<from:int,to:int>>"
    schema += ", clean_text string" if keep_text else ""

    def report(key, text, found, hit, items):
        import numpy as np
        n, n_hit, spans = len(found), int(hit.sum()), []
        if n_hit:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            places = [m.span() for m in re.finditer(PLAIN_WORD, ascii_lower(text))]
            spans = [{"from": places[a][0], "to": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
        names = ",".join(sorted(items))
        out = [key, n, n_hit, len(items), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0 and one_in * n_hit >= n, spans]
        if keep_text:
            pieces, last = [], 0
            for x in spans:
                pieces.append(text[last:x["from"]])
                last = x["to"]
            out.append(None if text is None else "".join(pieces) + text[last:])
        return out

    names = [x.split(" ")[0] for x in schema.replace("struct<from:int,to:int>", "").split(", ")]
    if slices == 1:
        sent = spark.sparkContext.broadcast(window_index([tuple(x) for x in test.collect()], size))

        def run(batches):
            import pandas as pd
            find, lower, index = re.compile(PLAIN_WORD).findall, ascii_lower, sent.value
            for batch in batches:
                out = [report(key, text, *scan_text(text, find, lower, index)) for key, text in zip(batch["_id"].tolist(), batch["_text"].tolist())]
                yield pd.DataFrame(out, columns=names)

        return named(rows.mapInPandas(run, schema), id_col, kind)

    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    part, marks = test.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices))), None
    for number in range(slices):
        sent = spark.sparkContext.broadcast(window_index([(x.item, x.text) for x in part.where(F.col("slice") == number).collect()], size))

        def scan(batches, sent=sent):
            import pandas as pd
            find, lower, index = re.compile(PLAIN_WORD).findall, ascii_lower, sent.value
            for batch in batches:
                out = []
                for key, text in zip(batch["_row"].tolist(), batch["_text"].tolist()):
                    _, hit, items = scan_text(text, find, lower, index)
                    if items:
                        out.append((key, hit.nonzero()[0].tolist(), sorted(items)))
                yield pd.DataFrame(out, columns=["_row", "hit", "items"])

        found = rows.select("_row", "_text").mapInPandas(scan, "_row long, hit array<int>, items array<string>")
        marks = found if marks is None else marks.unionByName(found)
    united = marks.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.flatten(F.collect_list("items")).alias("items"))

    def finish(batches):
        import numpy as np
        import pandas as pd
        find, lower = re.compile(PLAIN_WORD).findall, ascii_lower
        for batch in batches:
            out = []
            for key, text, places, items in zip(batch["_id"].tolist(), batch["_text"].tolist(), batch["hit"], batch["items"]):
                found = find(lower(text or ""))
                hit = np.zeros(len(found), dtype=bool)
                hit[[] if places is None else np.asarray(places, dtype=int)] = True
                out.append(report(key, text, found, hit, set([] if items is None else items)))
            yield pd.DataFrame(out, columns=names)

    return named(rows.join(united, "_row", "left").drop("_row").mapInPandas(finish, schema), id_col, kind)

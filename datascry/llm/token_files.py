"""Token ids in files of Simple-8b words: packed in blocks that are written and read without a loop over ids."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from datascry.llm.base import partitions
from datascry.llm.ranked_bpe import OTHER_SPACE

#: Fixed values of the format: ids per word for selectors 0 to 13 and the bits each of them has. Selector 15 announces an
#: escape: the next word is one whole id. The selector stands in the four highest bits, the first id in the lowest.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = 15
MAGIC = b"S8W1"
BLOCK = 256


def pack(ids) -> bytes:
    """Unsigned 64-bit ids as one segment: head (magic, block size, ids, blocks), word offset of each block, words.

    Every block of 256 ids starts a new word, so blocks are independent: the places where words begin are found for all blocks
    side by side, then the words are filled by selector. A word takes the most ids that its width allows; the rest of a
    block's last word is zero.
    """
    import numpy as np
    ids = np.asarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.zeros((blocks, BLOCK + 64), dtype=np.uint64)
    lengths = np.full(blocks, BLOCK)
    if n:
        whole = np.zeros(blocks * BLOCK, dtype=np.uint64)
        whole[:n] = ids
        padded[:, :BLOCK] = whole.reshape(blocks, BLOCK)
        lengths[-1] = n - (blocks - 1) * BLOCK
    # the first selector wide enough for each id (ESCAPE - 1: none), and its maximum over runs of ids, longer ones from shorter
    narrow = padded.astype(np.uint32) if n and ids.max() < 1 << 32 else padded
    needs = {1: np.zeros(padded.shape, np.uint8)}
    for width in WIDTHS:
        if 1 << width <= np.iinfo(narrow.dtype).max:
            needs[1] += narrow >= narrow.dtype.type(1 << width)
    for count in COUNTS[-2::-1]:
        half = -(-count // 2)
        size = BLOCK + 65 - count
        needs[count] = np.maximum(needs[half][:, :size], needs[half][:, count - half:count - half + size])
    # the selector that a word starting at each place would take: the first whose ids all fit, from many ids to one
    choice = np.full((blocks, BLOCK), ESCAPE, dtype=np.uint8)
    for selector in range(len(COUNTS) - 1, -1, -1):
        np.putmask(choice, needs[COUNTS[selector]][:, :BLOCK] <= selector, np.uint8(selector))
    steps = np.array(COUNTS + [0, 1])
    begins = np.zeros((blocks, BLOCK), dtype=bool)
    at, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    while len(live):
        begins[live, at[live]] = True
        at[live] += steps[choice[live, at[live]]]
        live = live[at[live] < lengths[live]]
    owner, place = np.nonzero(begins)
    chosen = choice[owner, place]
    ends = np.cumsum(1 + (chosen == ESCAPE))
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint64)
    for selector in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            flat[ends[mine] - 1] = padded[owner[mine], place[mine]]
            continue
        first = owner[mine] * padded.shape[1] + place[mine]
        for k in range(COUNTS[selector]):
            words[mine] |= padded.ravel()[first + k] << np.uint64(k * WIDTHS[selector])
    flat[ends - 1 - (chosen == ESCAPE)] = words
    offsets = np.zeros(blocks + 1, dtype="<u4")
    offsets[1:] = np.cumsum(np.bincount(owner, weights=1 + (chosen == ESCAPE), minlength=blocks)) if blocks else 0
    return struct.pack("<4sIQI", MAGIC, BLOCK, n, blocks) + offsets.tobytes() + flat.astype("<u8").tobytes()


def unpack(segment: bytes, first: int = 0, last: int | None = None):
    """Ids of blocks `first` to `last` (exclusive; all by default) of a segment, found by the block offsets."""
    import numpy as np
    magic, size, n, blocks = struct.unpack_from("<4sIQI", segment)
    if magic != MAGIC:
        raise ValueError("not a segment of Simple-8b words")
    last = blocks if last is None else min(last, blocks)
    head = struct.calcsize("<4sIQI")
    offsets = np.frombuffer(segment, "<u4", blocks + 1, head).astype(np.int64)
    if last <= first:
        return np.zeros(0, dtype=np.uint64)
    words = np.frombuffer(segment, "<u8", offsets[last] - offsets[first], head + 4 * (blocks + 1) + 8 * offsets[first])
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (selectors == ESCAPE).any():  # a raw word may look like an escape itself: settle runs of them from the left
        place = 0
        for place in np.nonzero(selectors == ESCAPE)[0]:
            if not raw[place]:
                raw[place + 1] = True
    counts = np.array(COUNTS + [0, 0])[selectors]
    counts[raw] = 1
    block = np.searchsorted(offsets[first:last + 1] - offsets[first], np.arange(len(words)), side="right") - 1
    ends = np.cumsum(counts)
    before = ends - counts
    starts = before[(offsets[first:last] - offsets[first])]
    inside = before - starts[block]
    out = np.zeros((last - first) * size + 64, dtype=np.uint64)
    for selector in np.unique(selectors[~raw]):
        if selector == ESCAPE:
            continue
        mine = np.nonzero((selectors == selector) & ~raw)[0]
        count, width = COUNTS[selector], WIDTHS[selector]
        values = (words[mine][:, None] >> (np.arange(count) * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
        places = inside[mine][:, None] + np.arange(count)
        kept = places < size
        out[(block[mine][:, None] * size + places)[kept]] = values[kept]
    mine = np.nonzero(raw)[0]
    out[block[mine] * size + inside[mine]] = words[mine]
    return out[:min(n - first * size, (last - first) * size)]


def chunk_encoder(path: str, kept: int = 600_000):
    """Function from texts to the ids of a tokenizer file, as bytes of uint32. Chunks of white space and what follows are looked up.

    A chunk ends where a blank or line feed follows a visible character; no match of the tokenizer's pattern crosses such a
    place, nor does a special token that stands in a text, so the ids of a text are those of its chunks, and words that recur are encoded once. New chunks are encoded many
    in a row: a row's ids fall to its chunks by the bytes that each id stands for. At most `kept` chunks are remembered.
    """
    import os
    import re

    import numpy as np
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, number in tokenizer.get_vocab().items():
        sizes[number] = len(token)  # a byte-level vocabulary spells each byte as one letter
    plain, other = re.compile("[ \\n]*[^ \\n]+|[ \\n]+"), re.compile(f"[{OTHER_SPACE}]")
    cut = re.compile(f"(?<=[^ \\n{OTHER_SPACE}])(?=[ \\n])")
    new: list[str] = []

    class Chunks(dict):
        def __missing__(self, chunk):  # an empty place, filled when the new chunks are encoded
            new.append(chunk)
            place = self[chunk] = bytearray()
            return place

    known = Chunks()

    def fill(chunks, ids):
        ids = list(ids)
        for place, found in zip(map(known.__getitem__, chunks), ids):
            place.extend(found)
        known.update(zip(chunks, ids))

    def learn():
        rows = [x for x in new if x[:1] in (" ", "\n") and not x[-1].isspace()]  # may stand side by side
        alone = list(set(new).difference(rows)) if len(rows) < len(new) else []
        new.clear()
        for start in range(0, len(alone), 1000):
            part = alone[start:start + 1000]
            fill(part, (np.array(x.ids, np.uint32).tobytes() for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)))
        for start in range(0, len(rows), 2000):
            part = rows[start:start + 2000]
            joined = "".join(part)
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            widths = list(map(len, part)) if joined.isascii() else [len(x) if x.isascii() else len(x.encode()) for x in part]
            ends = (4 * np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(widths)) + 4).tolist()
            flat = ids.tobytes()
            fill(part, map(flat.__getitem__, map(slice, [0, *ends], ends)))

    def chunks_of(text):
        if not text.replace("\n", "").isprintable() and other.search(text):  # no character of other is printable
            return cut.split(text)
        if "\0" in text or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
            return plain.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")  # single blanks: each starts a chunk

    def encode(texts):
        if len(known) > kept:
            known.clear()
        found = [list(map(known.__getitem__, chunks_of(x))) for x in texts]
        learn()
        return [b"".join(x) for x in found]

    return encode


def write_token_files(docs: DataFrame, out_dir: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None,
                      segment_ids: int = 1 << 18) -> None:
    """Encode every text and write the ids to `out_dir` as Parquet files of Simple-8b segments, in ascending id order.

    Rows go to ranges of (id, row), so one id held by many rows does not fill a task, and ties keep the order of the input.
    A segment holds whole documents and closes at `segment_ids` ids. Null ids come first (a segment names how many it has); null text is empty; `end_id` is
    appended to each document. An empty table gives no segment. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    value = int if kind in ("tinyint", "smallint", "int", "bigint") else str

    def run(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext
        shard, number = TaskContext.get().partitionId(), 0
        encode = chunk_encoder(path)
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32).tobytes()
        ids, parts, held, before = [], [], 0, 0

        def segment():
            lengths = [len(x) // 4 for x in parts]
            flat, named = np.frombuffer(b"".join(parts), np.uint32), [x for x in ids if x is not None]
            return pd.DataFrame({"shard": [shard], "segment": [number], "before": [before], "n_ids": [len(flat)], "n_null": [len(ids) - len(named)],
                                 "ids": [named], "lengths": [lengths], "words": [pack(flat)]})

        for batch in batches:
            texts, keys = batch["_text"].tolist(), batch["_key"].tolist()
            for start in range(0, len(texts), 512):
                for key, found in zip(keys[start:start + 512], encode([x or "" for x in texts[start:start + 512]])):
                    ids.append(None if key is None else value(key))
                    parts.append(found + tail)
                    held += len(parts[-1]) // 4
                    if held >= segment_ids:
                        yield segment()
                        ids, parts, held, number, before = [], [], 0, number + 1, before + held
        if ids:
            yield segment()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_key"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    spread = rows.repartitionByRange(partitions(docs.sparkSession), "_id", "_row").sortWithinPartitions("_id", "_row").select("_key", "_text")
    spread.mapInPandas(run, f"shard int, segment int, before long, n_ids long, n_null int, ids array<{kind}>, lengths array<int>, words binary").write.parquet(out_dir)


def read_token_files(spark, out_dir: str, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, token_ids) of every document in the files; with `digest`, ids_crc32 in place of the ids.

    `start` counts the ids of all documents before: sums over the shards, of which there are as many as the files were written
    by tasks, then what each segment tells of its shard, then inside the segment. Segments are read where they lie, without a shuffle.
    """
    files = spark.read.parquet(out_dir)
    kind = files.schema["ids"].dataType.elementType.simpleString()
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    rows = files.select("shard", "before", "n_null", "ids", "lengths", "words").join(F.broadcast(before), "shard")
    rows = rows.select((F.col("before") + F.col("shard_start")).alias("first"), "n_null", "ids", "lengths", "words")

    def run(batches):
        import zlib

        import numpy as np
        import pandas as pd
        for batch in batches:
            for first, n_null, ids, lengths, words in zip(batch["first"], batch["n_null"], batch["ids"], batch["lengths"], batch["words"]):
                flat = unpack(words).astype("<u4")
                lengths = np.asarray(lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                out = {"id": pd.Series([None] * n_null + list(ids), dtype=object), "start": first + ends - lengths, "n_tokens": lengths}
                if digest:
                    out["ids_crc32"] = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends - lengths, ends)]
                else:
                    out["token_ids"] = [flat[a:b].astype(np.int64) for a, b in zip(ends - lengths, ends)]
                yield pd.DataFrame(out)

    last = "ids_crc32 long" if digest else "token_ids array<long>"
    return rows.mapInPandas(run, f"id {kind}, start long, n_tokens long, {last}")

"""Byte-level BPE by a rank file: texts to ids and ids back to bytes, with long texts cut at safe places."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import named

#: Characters that some definition of white space holds besides the blank and the line feed. A cut never follows one of them.
OTHER_SPACE = "\\x00-\\x09\\x0b-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff"


def rank_table(path: str) -> dict[bytes, int]:
    """Ranks of a local rank file: each line holds a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_encoding(path: str, pattern: str):
    import tiktoken
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens={})


def safe_pieces(text: str, longest: int) -> Iterator[str]:
    """`text` in pieces of about `longest` characters, cut only before a blank or line feed that follows no white space.

    In the usual patterns of byte-level BPE no match reaches from a visible character into white space, and the only look
    ahead concerns white space that visible text follows, so the matches of the pieces are the matches of the text. A text
    without such a place after `longest` characters stays whole up to the next one.
    """
    if len(text) <= longest:
        yield text
        return
    import re
    place = re.compile(f"[^ \\n{OTHER_SPACE}](?=[ \\n])")
    start = 0
    while len(text) - start > longest:
        found = place.search(text, start + longest)
        if found is None:
            break
        yield text[start:found.end()]
        start = found.end()
    yield text[start:]


def small(batches, rows: int = 500):
    """Batches of at most `rows` rows, so that a task holds the ids of few texts at a time."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start:start + rows]


def encode_ranked(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  longest: int = 50_000) -> DataFrame:
    """(id, token_ids array<int>) of every row: each match of `pattern` merged by the ranks in `path`, no special tokens.

    One narrow step: a row's text is all a task holds. Null text is an empty text and gives an empty array; a null id stays
    null; repeated rows give repeated rows; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pandas as pd
        encoding = rank_encoding(path, pattern)
        for batch in small(batches):
            ids = []
            for text in batch["_text"]:
                found = []
                for piece in safe_pieces(text or "", longest):
                    found += encoding.encode_ordinary(piece)
                ids.append(np.array(found, dtype=np.int32))
            yield pd.DataFrame({"_id": batch["_id"], "token_ids": ids})

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    return named(rows.mapInPandas(run, "_id string, token_ids array<int>"), id_col, kind)


def decode_ranked(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded binary): the raw bytes of the ids. Bytes need not be valid text; null ids give no bytes (an empty value)."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        import pandas as pd
        encoding = rank_encoding(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "decoded": [encoding.decode_bytes([] if x is None else x.tolist()) for x in batch["_ids"]]})

    rows = tokens.select(F.col(id_col).cast("string").alias("_id"), F.col(ids_col).alias("_ids"))
    return named(rows.mapInPandas(run, "_id string, decoded binary"), id_col, kind)


def encoding_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """Per row: number of ids, digest of the ids as little-endian unsigned 32-bit integers, digest of the decoded bytes; with `keep_ids` the ids too.

    Encodes with `encode_ranked`, then decodes those ids with the encoding's bytes of each id. The cases are those of
    `encode_ranked`; an empty text has no ids and the digest of no bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pandas as pd
        encoding = rank_encoding(path, pattern)
        for batch in small(batches):
            ids = [x if x is not None else [] for x in batch["token_ids"]]
            more = {"token_ids": ids} if keep_ids else {}
            yield pd.DataFrame({
                "_id": batch["_id"], **more, "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes() if len(x) else b"").hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(encoding.decode_bytes(x.tolist() if len(x) else [])).hexdigest() for x in ids]})

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    encoded = encode_ranked(rows, path, pattern, "_id", "_text")
    out = encoded.mapInPandas(run, f"_id string, {'token_ids array<int>, ' if keep_ids else ''}n_tokens long, ids_sha256 string, decoded_sha256 string")
    return named(out, id_col, kind)

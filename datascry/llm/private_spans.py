"""Personal data: spans by pattern and, beside them, spans that a letter model trained on labelled spans finds."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import named
from datascry.llm.char_crf import best_paths, symbols, train

#: Fixed by the task, in this order.
KINDS = ["email", "ip", "card", "phone"]
#: Windows of the model: letters in one, letters between two starts. Every letter stands in two windows.
WINDOW, STRIDE = 64, 32
#: What a span of the model must hold: a digit, an @ or an at in brackets. Windows without one are not decoded.
TRIGGER = "[0-9@]|[(\\[{<] ?at ?[)\\]}>]"


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(text: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits(text))):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str):
    """(kind, start, end) by the fixed patterns, and the matches that failed their checks. Time follows the length of the text."""
    found, failed = [], []
    # email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ : from each @ to the left as far as the last match, then to the right
    last, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        if domain:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append(("email", start, domain.end()))
                last = domain.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in PATTERNS:
        for match in pattern.finditer(text):
            n = len(digits(match[0]))
            if kind == "ip":
                good = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in match[0].split("."))
            else:
                good = 12 <= n <= 19 and luhn(match[0]) if kind == "card" else 9 <= n <= 15
            (found if good else failed).append((kind, match.start(), match.end()))
    return found, failed


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile("@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)+")
#: The fixed patterns; an ip cannot begin inside a run of digits whose beginning failed, which the first part says.
PATTERNS = [("ip", re.compile("(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++")),
            ("card", re.compile("[0-9](?:[ -]?[0-9])+")),
            ("phone", re.compile("\\+[0-9][ ().0-9-]+[0-9]"))]


def written_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def windows_of(text: str, finder):
    """Starts of the windows that hold a trigger."""
    starts = set()
    for match in finder.finditer(text):
        k = match.start() // STRIDE
        starts.update(x * STRIDE for x in (k - 1, k) if x >= 0)
    return sorted(starts)


def coded(text: str, start: int):
    import numpy as np
    part = symbols(text[start:start + WINDOW])
    return np.concatenate([part, np.full(WINDOW - len(part), 130)])


def variants(kind: str, text: str, rng) -> str:
    """The same kind of datum with other letters and digits, and written in other usual ways."""
    text = "".join(str(rng.integers(10)) if c.isascii() and c.isdigit() and k else c for k, c in enumerate(text))
    way = rng.integers(4)
    if kind == "email":
        name, _, host = text.partition("@")
        at = ["@", "@", " (at) ", " [at] "][way]
        return f"{name[::-1] if way % 2 else name}{at}{host}"
    if kind == "card":
        d = digits(text)[:15]
        check = next(str(c) for c in range(10) if luhn(d + str(c)))
        d += check
        return d if way < 2 else (" " if way == 2 else "-").join(d[k:k + 4] for k in range(0, len(d), 4))
    if kind == "phone":
        d = digits(text)
        return [text, text.lstrip("+"), f"{d[:3]}-{d[3:6]}-{d[6:10]}", f"({d[:3]}) {d[3:6]}-{d[6:]}"][way]
    return ".".join(str(rng.integers(256)) for _ in range(4))


def training_windows(texts: list[str], most: int, seed: int = 11):
    """Windows (N, T) and tags (N, T) from labelled spans of the texts, each also with variants, and from places without any."""
    import numpy as np
    rng, codes, tags = np.random.default_rng(seed), [], []

    def add(text, spans, start):
        line = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            line[a:b] = 2 + 2 * KINDS.index(kind)
            line[a] -= 1
        part = line[start:start + WINDOW]
        codes.append(coded(text, start))
        tags.append(np.concatenate([part, np.zeros(WINDOW - len(part), np.int64)]))

    finder = re.compile(TRIGGER)
    for text in texts:
        spans, failed = base_spans(text)
        spans = [s for s in spans if s[2] - s[1] < WINDOW and not any(o is not s and o[1] < s[2] and s[1] < o[2] for o in spans)]
        for kind, a, b in spans:
            before, after = text[max(0, a - 60):a], text[b:b + 60]
            for kind_now, datum in [(kind, text[a:b]), (kind, variants(kind, text[a:b], rng))] + [(k, made(k, rng)) for k in KINDS]:
                near = re.sub("[0-9@]", "x", before), re.sub("[0-9@]", "x", after)
                local = near[0] + datum + near[1]
                add(local, [(kind_now, len(near[0]), len(near[0]) + len(datum))], max(0, len(near[0]) - int(rng.integers(4, 40))))
        taken = [(a, b) for _, a, b in spans]
        for start in windows_of(text, finder)[:8]:
            if not any(a < start + WINDOW and start < b for a, b in taken):
                add(text, [], start)
        if text:
            add(re.sub("[0-9@]", "x", text[:WINDOW]), [], 0)
        if len(codes) >= most:
            break
    return np.array(codes[:most]), np.array(tags[:most])


def made(kind: str, rng) -> str:
    """A datum of the kind out of nothing, so that each kind is learnt even where the texts lack it."""
    d = "".join(str(x) for x in rng.integers(0, 10, 16))
    letters = "".join(chr(97 + x) for x in rng.integers(0, 26, 12))
    plain = {"email": f"{letters[:6]}.{d[:2]}@{letters[6:10]}.example.com", "ip": "1.2.3.4", "card": "4" + d[1:], "phone": f"+1 ({d[:3]}) {d[3:6]}-{d[6:10]}"}[kind]
    return variants(kind, plain, rng)


def model_spans(text: str, starts: list[int], paths, taken) -> list:
    """Spans of the windows' paths: every letter takes its tag from the window in which it stands most central, runs of one
    kind are one span, and a span stays if it is what its kind can be and touches no span or failed match of the patterns."""
    import numpy as np
    if not starts or not paths.any():
        return []
    tags, depth = {}, {}
    for start, path in zip(starts, paths):
        for k in range(min(WINDOW, len(text) - start)):
            near = min(k, WINDOW - 1 - k)
            if near > depth.get(start + k, -1):
                depth[start + k], tags[start + k] = near, int(path[k])
    spans, now = [], None
    for place in sorted(tags):
        tag = tags[place]
        kind = (tag - 1) // 2 if tag else None
        if now and (kind != now[0] or tag % 2 == 1 or place != now[2]):
            spans.append(now)
            now = None
        if tag:
            now = (kind, now[1] if now else place, place + 1)
    if now:
        spans.append(now)
    out = []
    for k, a, b in spans:
        while a < b and text[a] in " \n\t.,;":
            a += 1
        while a < b and text[b - 1] in " \n\t.,;":
            b -= 1
        if a < b and plausible(KINDS[k], text, a, b) and not any(x < b and a < y for x, y in taken):
            out.append((KINDS[k], a, b))
    return out


def plausible(kind: str, text: str, a: int, b: int) -> bool:
    """A whole datum of its kind: bounded by no letter or digit, and of the shape and number of digits that the kind has."""
    datum, n = text[a:b], len(digits(text[a:b]))
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    if kind == "email":
        return bool(re.fullmatch("[A-Za-z0-9._%+-]+ ?(?:@|[(\\[{<] ?at ?[)\\]}>]) ?[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", datum))
    if kind == "ip":
        return bool(re.fullmatch("[0-9]{1,3}(?:[. ]{1,3}[0-9]{1,3}){3}", datum)) and all(int(x) <= 255 for x in re.findall("[0-9]+", datum))
    if kind == "card":
        return 12 <= n <= 19 and bool(re.fullmatch("[0-9][0-9 .-]+[0-9]", datum)) and luhn(datum)
    return 9 <= n <= 15 and bool(re.fullmatch("[(+]?[0-9][0-9 ().-]*[0-9]", datum)) and len(re.findall("[ ().-]+", datum)) >= 2


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_texts: int = 400, train_windows: int = 1000) -> DataFrame:
    """Per row: n_email, n_ip, n_card, n_phone (spans of the patterns), base_sha256, spans (all, as kind:start:end), n_added.

    The patterns label the training data: `train_texts` texts with a match, those with the smallest hash, give at most
    `train_windows` windows, a documented bound; a bidirectional LSTM over letters with CRF transitions is trained on them in
    numpy. Every whole text is then read in overlapping windows wherever a digit, an @ or an at in brackets stands, which any
    datum holds; the windows' best paths are reconciled over the text. Spans of the patterns always stay; the model adds
    spans that touch none of them. Offsets are code points, ends exclusive.

    Null and empty texts have no spans; texts of any length are read whole, at most 512 windows at a time; a table without any
    match trains on made data alone; repeated rows return as they stand; a null id stays null; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    # a long text stands with its first match in view; only what is labelled is cut here, never what is searched
    view = F.expr("substring(_text, greatest(1, regexp_instr(_text, '@[A-Za-z0-9-]+[.]|[0-9][.][0-9]+[.][0-9]+[.]|[0-9]{6}|[+][0-9]') - 200), 2000)")
    hashed = rows.select(F.xxhash64("_id", "_text").alias("h"), "_text")
    texts, share = [], min(1.0, 40 * train_texts / max(1, rows.count()))
    while True:  # the smallest hashes only, so that what the driver gets does not follow the number of tasks; more of them where matches are rare
        near = hashed.where(F.col("h") <= min(2 ** 63 - 1, int(share * 2 ** 64) - 2 ** 63))
        likely = near.where(F.col("_text").rlike("@[A-Za-z0-9-]+\\.|[0-9]\\.[0-9]+\\.[0-9]+\\.|[0-9]{6}|\\+[0-9]"))
        texts = [x.v for x in likely.select("h", view.alias("v")).orderBy("h", "v").limit(train_texts).collect()]
        if len(texts) >= train_texts or share >= 1:
            break
        share = min(1.0, 16 * share)
    codes, tags = training_windows(texts + ["no more than plain words here 0 and 2.0 there +1 (632) 555-4827 end"], train_windows)
    sent = spark.sparkContext.broadcast(train(codes, tags, 1 + 2 * len(KINDS)))

    def run(batches):
        import numpy as np
        import pandas as pd
        finder, p = re.compile(TRIGGER), sent.value
        for batch in batches:
            texts = [x or "" for x in batch["_text"].tolist()]
            starts = [windows_of(x, finder) for x in texts]
            wanted = [(k, s) for k, x in enumerate(starts) for s in x]
            paths = [np.zeros((0, WINDOW), np.int64)]
            for first in range(0, len(wanted), 512):
                part = wanted[first:first + 512]
                paths.append(best_paths(p, np.array([coded(texts[k], s) for k, s in part])).astype(np.int8))
            paths, at, out = np.concatenate(paths), 0, []
            for key, text, mine in zip(batch["_id"].tolist(), texts, starts):
                base, failed = base_spans(text) if mine else ([], [])
                added = model_spans(text, mine, paths[at:at + len(mine)], [(a, b) for _, a, b in base + failed])
                at += len(mine)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((key, *counts, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(base + added), len(added)))
            yield pd.DataFrame(out, columns=["_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    schema = "_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return named(rows.mapInPandas(run, schema), id_col, kind)

"""Quality by an interpolated modified Kneser-Ney model over letters, learnt from trusted texts of each language."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import named, short_batches, written
from datascry.llm.blocks import BLOCK_BYTES, answered, in_blocks
from datascry.operators.quantiles import quantiles

#: Letters that a model knows, as many as fit 8 bits besides 0, which stands for every other letter and for the text's start.
LETTERS = 255
#: Different grams of all texts whose logarithms are broadcast at most: 16 bytes each. Beyond it texts go to blocks and fetch theirs.
BROADCAST_GRAMS = 1_000_000
#: What a short text's deviation is shrunk by: as if so many letters, or pairs of words, of the trusted average stood in it besides.
AVERAGE_LETTERS, AVERAGE_PAIRS = 100, 50
#: A sign of toxic text: a word, or the start of one, that is in so many toxic teaching texts, in at least that share of them, and so
#: many times likelier there than in clean ones. The share keeps the number of signs independent of the number of texts. Starts have 3
#: to STARTS letters. Words without a sign that an average text holds besides.
SIGN_TEXTS, SIGN_SHARE, SIGN_RATIO, STARTS, AVERAGE_WORDS = 3, 1 / 500, 5.0, 10, 50
#: Different grams, or signs, that a task counts before it hands the counts on.
HELD_COUNTS = 500_000
#: Words whose signs a task remembers.
HELD_WORDS = 200_000


def letter_codes(text: str, codes, order: int):
    """uint64 code of the `order` letters that end at each place of the text; 8 bits a letter, the last letter lowest."""
    import numpy as np
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = codes[np.minimum(points, len(codes) - 1)].astype(np.uint64)
    line = np.concatenate([np.zeros(order - 1, np.uint64), letters])
    total = np.zeros(len(letters), np.uint64)
    for k in range(order):
        total = (total << np.uint64(8)) | line[k:k + len(letters)]
    return total


def alphabet(texts: DataFrame):
    """Array from code point to letter code: the commonest letters of the trusted texts, 0 for all others."""
    import numpy as np

    def run(batches):
        import pandas as pd
        counts = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch["_text"].tolist():
                points, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
                counts[points] += n
        found = np.nonzero(counts)[0]
        yield pd.DataFrame({"point": found, "n": counts[found]})

    rows = texts.select("_text").mapInPandas(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    codes = np.zeros(0x110001, np.uint8)
    for k, row in enumerate(rows.orderBy(F.desc("n"), "point").limit(LETTERS).collect()):
        codes[row.point] = k + 1
    return codes


def gram_counts(texts: DataFrame, codes, order: int, overall: bool = False) -> DataFrame:
    """(model, k, code, c): counts of the longest grams, and for shorter ones the number of different letters seen before them.

    overall: the model named '' gets the counts of all models.
    """
    sent = texts.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        import numpy as np
        import pandas as pd
        held: dict[str, tuple] = {}

        def told(model):
            every, n = held.pop(model)
            return pd.DataFrame({"model": model, "code": every.astype(np.int64), "c": n})

        for batch in batches:
            for model, group in batch.groupby("model"):
                every, n = np.unique(np.concatenate([letter_codes(x, sent.value, order) for x in group["_text"].tolist()]), return_counts=True)
                if model in held:
                    (old, n_old), fresh, n_fresh = held[model], every, n
                    every, back = np.unique(np.concatenate([old, fresh]), return_inverse=True)
                    n = np.zeros(len(every), np.int64)
                    np.add.at(n, back, np.concatenate([n_old, n_fresh]))
                held[model] = every, n
                if len(every) > HELD_COUNTS:
                    yield told(model)
        for model in list(held):
            yield told(model)

    grams = texts.select("model", "_text").mapInPandas(run, "model string, code long, c long").groupBy("model", "code").agg(F.sum("c").alias("c"))
    level = written(grams, "grams")
    if overall:
        level = level.where("model <> ''").unionByName(level.groupBy("code").agg(F.sum("c").alias("c")).select(F.lit("").alias("model"), "code", "c"))
    every = level.select("model", F.lit(order).alias("k"), "code", "c")
    for k in range(order - 1, 0, -1):
        level = level.groupBy("model", F.col("code").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("code")).agg(F.count("*").alias("c"))
        every = every.unionByName(level.select("model", F.lit(k).alias("k"), "code", "c"))
    return written(every, "gram-counts")


def discounts(counts: DataFrame) -> dict:
    """{(model, k): (D1, D2, D3)}: the three discounts of modified Kneser-Ney from the counts of counts."""
    kept = {}
    facts = counts.groupBy("model", "k").agg(*[F.sum(F.when(F.col("c") == n, 1).otherwise(0)).alias(f"n{n}") for n in (1, 2, 3, 4)]).collect()
    for row in facts:
        n1, n2, n3, n4 = row.n1, row.n2, row.n3, row.n4
        if not (n1 and n2 and n3):
            kept[row.model, row.k] = (0.5, 0.75, 0.9)  # too few different counts to estimate
            continue
        y = n1 / (n1 + 2 * n2)
        kept[row.model, row.k] = tuple(min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))
    return kept


def gram_logs(wanted, counts, order: int, cuts: dict, unigrams: dict):
    """log10 probability of the wanted codes of one model and second-last letter, from that shard's counts of all orders.

    All grams that share their second-last letter are in one shard, with every gram of their contexts and of their suffixes,
    so sums over contexts are whole here.
    """
    import numpy as np
    model = wanted["model"].iloc[0]
    codes = wanted["code"].to_numpy().astype(np.uint64)
    p = unigrams.get(model, np.full(256, 1 / 256))[(codes & np.uint64(255)).astype(np.int64)]
    for k in range(2, order + 1):
        rows = counts[counts["k"] == k]
        if not len(rows):
            break
        known = rows["code"].to_numpy().astype(np.uint64)
        place = np.argsort(known)
        known, c = known[place], rows["c"].to_numpy()[place].astype(float)
        d = np.array((0.0, *cuts[model, k]))[np.minimum(c, 3).astype(int)]
        contexts, start = np.unique(known >> np.uint64(8), return_index=True)
        total, mass = np.add.reduceat(c, start), np.add.reduceat(d, start)
        suffix = codes & np.uint64((1 << (8 * k)) - 1)
        at = np.minimum(np.searchsorted(known, suffix), len(known) - 1)
        over = np.where(known[at] == suffix, c[at] - d[at], 0.0)
        near = np.minimum(np.searchsorted(contexts, suffix >> np.uint64(8)), len(contexts) - 1)
        seen = contexts[near] == suffix >> np.uint64(8)
        p = np.where(seen, (over + mass[near] * p) / total[near], p)
    return np.log10(p)


class LetterModel:
    """Counts of all orders as a sharded table; alphabet, discounts and single letters, which have a fixed size, beside it."""

    def __init__(self, trusted: DataFrame, order: int, overall: bool = False):
        """trusted: (model, _text). overall: the model named '' learns from the texts of all models."""
        import numpy as np
        trusted = trusted.where("_text is not null and model is not null")
        self.order = order
        self.codes = alphabet(trusted)
        self.counts = gram_counts(trusted, self.codes, order, overall)
        self.cuts = discounts(self.counts)
        self.unigrams: dict = {}
        for row in self.counts.where("k = 1").collect():
            self.unigrams.setdefault(row.model, np.zeros(256))[row.code] = row.c
        for model, c in self.unigrams.items():
            d = np.array((0.0, *self.cuts[model, 1]))[np.minimum(c, 3).astype(int)]
            self.unigrams[model] = (c - d) / c.sum() + d.sum() / c.sum() / 256


def letter_perplexity(docs: DataFrame, letters: LetterModel, signs: dict | None = None, keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(model, _text, ...) with n_letters, perplexity, n_pairs, repeated and toxicity (see toxic_scorer), without _text unless asked for.

    repeated: share of the n_pairs pairs of adjacent words that stood in the text before; null where there is no pair. All measures
    of a text are taken in one pass by one worker.

    The different grams of all texts meet the sharded counts in a join, once each. Their logarithms are broadcast while there
    are few of them (counted first); beyond that blocks of texts fetch those of their own grams. A text whose model has no
    trusted text is scored by uniform letters.
    """
    import numpy as np
    spark, order, cuts, unigrams, counts = docs.sparkSession, letters.order, letters.cuts, letters.unigrams, letters.counts
    sent, sent_signs = spark.sparkContext.broadcast(letters.codes), spark.sparkContext.broadcast(signs or {})
    extra = [f for f in docs.schema.fields if keep_text or f.name != "_text"]

    def ask(batches):
        import pandas as pd
        held: dict[tuple, list] = {}

        def told(key):
            every = np.unique(np.concatenate(held.pop(key)))
            return pd.DataFrame({"_block": key[0], "model": key[1], "code": every.astype(np.int64)})

        sizes: dict[tuple, int] = {}
        for batch in batches:
            for block, model, text in zip(batch["_block"].tolist(), batch["model"].tolist(), batch["_text"].tolist()):
                if not text or model is None:
                    continue
                key = (block, model)
                held.setdefault(key, []).append(letter_codes(text, sent.value, order))
                sizes[key] = sizes.get(key, 0) + len(held[key][-1])
                if sizes[key] > 1_000_000:
                    parts = [np.unique(np.concatenate(held[key]))]
                    held[key], sizes[key] = parts, len(parts[0])
                    if sizes[key] > 500_000:
                        yield told(key)
                        sizes[key] = 0
        for key in list(held):
            yield told(key)

    asking = "_block int, model string, code long"
    everywhere = docs.select(F.lit(0).alias("_block"), "model", "_text").mapInPandas(ask, asking)
    wanted = written(everywhere.select("model", "code").distinct(), "wanted-grams")
    shard = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(255)).cast("int").alias("shard")
    tables = counts.where("k >= 2").select("*", shard)

    def answer(want, have):
        import pandas as pd
        if not len(want):
            return pd.DataFrame({"model": [], "code": [], "logp": []}).astype({"model": object, "code": "int64", "logp": "float64"})
        return pd.DataFrame({"model": want["model"], "code": want["code"], "logp": gram_logs(want, have, order, cuts, unigrams)})

    logs = wanted.select("*", shard).groupBy("model", "shard").cogroup(tables.groupBy("model", "shard")).applyInPandas(answer, "model string, code long, logp double")
    logs = written(logs, "gram-logs")

    def look_up(frame, tables, toxic):
        import pandas as pd
        sizes, values, pairs, again = [], [], [], []
        poison = [toxic(model, text) for model, text in zip(frame["model"].tolist(), frame["_text"].tolist())]
        for model, text in zip(frame["model"].tolist(), frame["_text"].tolist()):
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            n_pairs = max(len(words) - 1, 0)
            pairs.append(n_pairs)
            again.append(1 - len(set(zip(words, words[1:]))) / n_pairs if n_pairs else None)
            if not text:
                sizes.append(0)
                values.append(None)
            elif model is None:
                sizes.append(len(text))
                values.append(256.0)
            else:
                known, found = tables[model]
                mine, n = np.unique(letter_codes(text, sent.value, order), return_counts=True)
                at = np.searchsorted(known, mine)
                if not (known[np.minimum(at, len(known) - 1)] == mine).all():
                    raise RuntimeError("a text lacks answers: the input gave other rows when it was read again")
                sizes.append(int(n.sum()))
                values.append(float(10 ** -(found[at] @ n / n.sum())))
        out = frame[[f.name for f in extra]].copy()
        out["n_letters"], out["perplexity"] = sizes, pd.Series(values, dtype=float, index=out.index)
        out["n_pairs"], out["repeated"] = pairs, pd.Series(again, dtype=float, index=out.index)
        out["toxicity"] = pd.Series(poison, dtype=float, index=out.index)
        return out

    def sorted_logs(rows):
        known, first = np.unique(rows["code"].to_numpy().astype(np.uint64), return_index=True)
        return known, rows["logp"].to_numpy()[first]

    def by_model(found):
        return {model: sorted_logs(rows) for model, rows in found.groupby("model")}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in extra) + ", n_letters long, perplexity double, n_pairs long, repeated double, toxicity double"
    if wanted.count() <= BROADCAST_GRAMS:
        models = [x.model for x in logs.select("model").distinct().collect()]
        parts = {m: logs.where(F.col("model") == m).select("code", "logp").toArrow() for m in models}  # columns of numbers: a row object each would fill the driver
        told = spark.sparkContext.broadcast({m: sorted_logs(x) for m, x in parts.items()})

        def every(batches):
            toxic = toxic_scorer(sent_signs.value)
            for batch in batches:
                yield look_up(batch, told.value, toxic)

        return docs.mapInPandas(every, schema)
    blocked = in_blocks(docs, "_text", block_bytes)
    asked = blocked.select("_block", "model", "_text").mapInPandas(ask, asking)
    answers = asked.join(logs, ["model", "code"]).select("_block", "model", "code", "logp")
    return answered(blocked, answers, lambda frame, found: look_up(frame, by_model(found), toxic_scorer(sent_signs.value)), schema)


def bare(word: str) -> str:
    """The word without marks and digits at its ends."""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while a < b and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def word_signs(word: str) -> list[str]:
    """The word with a blank behind it and its starts; marks and digits at its ends do not count, nor words under 3 letters."""
    word = bare(word)
    return [word + " ", *[word[:k] for k in range(3, min(len(word), STARTS) + 1)]] if len(word) >= 3 else []


class FoundSigns(dict):
    """From a word to those of its signs that are among `signs`. Remembers `held` words.

    All beginnings of the signs are kept, so a word is followed only as far as some sign agrees with it.
    """

    def __init__(self, signs, held: int):
        super().__init__()
        self.held = held
        self.begun = dict.fromkeys((s[:k] for s in signs for k in range(3, len(s))), "")
        self.begun.update(zip(signs, signs))

    def __missing__(self, word: str) -> tuple:
        if len(self) > self.held:
            self.clear()
        found = self[word] = self.signs_of(word)
        return found

    def signs_of(self, word: str) -> tuple:
        line, begun, found = (word if word[0].isalpha() and word[-1].isalpha() else bare(word)) + " ", self.begun, ()
        for k in range(3, len(line) + 1):
            sign = begun.get(line[:k])
            if sign is None:
                break
            if sign:
                found += (sign,)
        return found


class WordWeights(dict):
    """From a word to the weight of its heaviest sign, 0 without one. Remembers `held` words."""

    def __init__(self, signs: dict, held: int):
        super().__init__()
        self.signs, self.held, self.find = signs, held, FoundSigns(signs, 0).signs_of

    def __missing__(self, word: str) -> float:
        if len(self) > self.held:
            self.clear()
        weight = self[word] = max(map(self.signs.__getitem__, self.find(word)), default=0.0)
        return weight


def sign_counts(texts: DataFrame, wanted: dict | None = None) -> DataFrame:
    """(model, sign, n): in how many texts of texts(model, _text) a sign is; of `wanted` (model to signs), where given, those alone."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        from collections import Counter

        import pandas as pd
        asked, counts = sent.value, {}
        finders = {model: FoundSigns(signs, HELD_WORDS // len(asked)).__getitem__ for model, signs in (asked or {}).items()}

        def told(model):
            found = counts.pop(model)
            return pd.DataFrame({"model": model, "sign": pd.Series(list(found), dtype=object), "n": list(found.values())})

        for batch in batches:
            for model, text in zip(batch["model"].tolist(), batch["_text"].tolist()):
                words = set(text.lower().split())
                if asked is None:
                    found = {s for w in words for s in word_signs(w)}
                else:
                    found = set().union(*map(finders[model], words))
                counts.setdefault(model, Counter()).update(found)
                if len(counts[model]) > HELD_COUNTS:
                    yield told(model)
        for model in list(counts):
            yield told(model)

    return texts.select("model", "_text").mapInPandas(run, "model string, sign string, n long").groupBy("model", "sign").agg(F.sum("n").alias("n"))


def toxic_signs(teach: DataFrame, overall: bool = False) -> dict:
    """{model: {sign: weight}} of teach(model, toxic, _text): log of how much likelier a sign is in toxic texts; counted once a text.

    Toxic texts tell which signs are common enough, the clean ones then count those alone. overall: the model named '' learns
    from the texts of all models.
    """
    def totals(counted, *by):
        if not overall:
            return counted
        return counted.where("model <> ''").unionByName(counted.groupBy(*by).agg(F.sum("n").alias("n")).select(F.lit("").alias("model"), *by, "n"))

    sizes = {(x.model, x.toxic): x.n for x in totals(teach.groupBy("model", "toxic").agg(F.count("*").alias("n")), "toxic").collect()}
    needed = {m: max(SIGN_TEXTS, n * SIGN_SHARE) for (m, toxic), n in sizes.items() if toxic}
    if not needed:
        return {}
    spark = teach.sparkSession
    enough = spark.createDataFrame([(m, float(n)) for m, n in needed.items()], "model string, needed double")
    bad = totals(sign_counts(teach.where("toxic")), "sign").join(F.broadcast(enough), "model").where("n >= needed").select("model", "sign", "n")
    bad = written(bad, "toxic-signs")
    found = {m: bad.where(F.col("model") == m).select("sign").toArrow()["sign"].to_pylist() for m in needed}
    models = [x.model for x in teach.select("model").distinct().collect()]
    wanted = {m: list({*found.get(m, ()), *(found.get("", ()) if overall else ())}) for m in models}
    clean = totals(sign_counts(teach.where("not toxic"), wanted), "sign").withColumnRenamed("n", "n_clean")
    del found, wanted
    # weighed where the counts are, so the driver gets the signs that count and not the candidates; the log itself is taken here
    of = spark.createDataFrame([(m, sizes[m, True] + 1, sizes.get((m, False), 0) + 1) for m in needed], "model string, of_toxic long, of_clean long")
    both = bad.join(clean, ["model", "sign"], "left").join(F.broadcast(of), "model").withColumn("n_clean", F.coalesce("n_clean", F.lit(0)))
    ratio = (F.col("n") + 0.5) / F.col("of_toxic") / ((F.col("n_clean") + 0.5) / F.col("of_clean"))
    heavy = both.where(ratio >= SIGN_RATIO * (1 - 1e-9)).select("model", "sign", "n", "n_clean").toArrow()
    signs: dict[str, dict] = {}
    for model, sign, n, n_clean in zip(*(c.to_pylist() for c in heavy.columns)):
        weight = math.log((n + 0.5) / (sizes[model, True] + 1) / ((n_clean + 0.5) / (sizes.get((model, False), 0) + 1)))
        if weight >= math.log(SIGN_RATIO):
            signs.setdefault(model, {})[sign] = weight
    return signs


def toxic_scorer(signs: dict):
    """score(model, text): the sum of its words' heaviest signs per word, AVERAGE_WORDS words without one added; None without signs or text."""
    known = {model: WordWeights(weights, HELD_WORDS // len(signs)) for model, weights in signs.items() if weights}

    def score(model, text):
        if model not in known or not text:
            return None
        words = text.lower().split()
        return sum(map(known[model].__getitem__, words)) / (len(words) + AVERAGE_WORDS)

    return score


def tail_limit(column: str, share: float, quantile):
    """The quantile, or the normal tolerance limit (confidence 0.95) from mean and spread where that is further out."""
    z, sure, n = abs(NormalDist().inv_cdf(share)), NormalDist().inv_cdf(0.95), F.greatest(F.count(column), F.lit(4))
    a = 1 - sure ** 2 / (2 * (n - 1))
    tail = F.stddev_pop(column) * (z + F.sqrt(z ** 2 - a * (z ** 2 - sure ** 2 / n))) / a
    if share < 0.5:
        return F.least(quantile, F.mean(column) - tail)
    return F.greatest(quantile, F.mean(column) + tail)


def shrunk(value, mean, n, average: int):
    """Deviation from the trusted mean, smaller the shorter the text."""
    return (F.col(value) - F.col(mean)) * F.col(n) / (F.col(n) + average)


def trusted_limits(audit: DataFrame, low: float, high: float) -> DataFrame:
    """(model, mean, low, high, repeated_mean, repeated_high, toxicity_limit) of audit(model, taught, n_letters, perplexity, n_pairs, repeated, toxicity).

    Texts that did not teach tell the means and the upper limits. The model knows a text that taught, and copies of it, better
    than others, which speaks for them: the lower limit comes from those that taught.

    low, high: those quantiles of the shrunk deviations, or the normal tolerance limits from their mean and spread (confidence
    0.95) when these are further out: few texts do not show a quantile near 0 or 1, and the more there are the less it matters.
    """
    audit = written(audit.where("perplexity is not null").withColumn("lp", F.log10("perplexity")), "audited")
    means = audit.where("not taught").groupBy("model").agg((F.sum(F.col("lp") * F.col("n_letters")) / F.sum("n_letters")).alias("mean"),
                                       F.coalesce(F.try_divide(F.sum(F.col("repeated") * F.col("n_pairs")), F.sum("n_pairs")), F.lit(0.0)).alias("repeated_mean"))
    audit = audit.join(F.broadcast(means), "model").select("model", "taught", "toxicity", "mean", "repeated_mean", shrunk("lp", "mean", "n_letters", AVERAGE_LETTERS).alias("x"),
                                                           shrunk("repeated", "repeated_mean", "n_pairs", AVERAGE_PAIRS).alias("r"))

    audit = audit.withColumn("low", F.when(F.col("taught"), F.col("x"))).withColumn("high", F.when(~F.col("taught"), F.col("x"))).withColumn("r", F.when(~F.col("taught"), F.col("r")))
    audit = audit.withColumn("toxicity", F.when(~F.col("taught"), F.col("toxicity")))
    shares = {"low": low, "high": high, "r": high, "toxicity": high}
    points = quantiles(audit, list(shares), [low, high], by=["model"])
    points = points.groupBy("model").agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0 if share == low else 1])).alias(f"q_{c}") for c, share in shares.items()])
    limits = [tail_limit(c, share, F.max(f"q_{c}")).alias(name) for (c, share), name in zip(shares.items(), ("low", "high", "repeated_high", "toxicity_limit"))]
    return audit.join(F.broadcast(points), "model").groupBy("model", "mean", "repeated_mean").agg(*limits)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id: str = "doc_id",
            label_col: str = "quality", toxic_col: str = "toxic", low: float = 0.002, high: float = 0.998, order: int = 4,
            carry: tuple = (), keep_text: bool = False) -> DataFrame:
    """Per row: lang, n_letters, perplexity, low_limit, high_limit, repeated, repeated_limit, toxicity, toxicity_limit, kept (the columns named in `carry`, and with `keep_text` the text).

    Trusted texts are rows that the labels call 1 in `label_col` and not 1 in `toxic_col`, all of them, equal rows once; those whose
    hash of id and text is odd teach the model, the others set its limits. Two measures are limited: the mean log probability of a letter, either way, and the share of pairs of adjacent words that the text held
    before (repetition that the letters do not show), from above. A short text varies more, so its deviation from the trusted
    mean is shrunk by its length; the limits are the quantiles `low` and `high` of the shrunk deviations, and the limits told
    for a row are those of its own length. A third measure looks for toxic text where labels have `toxic_col`: words and starts
    of words that are likelier in all texts labelled toxic than in the trusted texts that teach, weighed by that log ratio per word; its limit is the quantile `high` of the other trusted texts. Text outside a limit is rejected. Everything is scored, each text whole.

    A language with fewer than 20 trusted texts (and null) uses a model and limits from the texts of all languages. Empty and
    null texts have no perplexity and are kept: nothing speaks against them. Without trusted text everything is kept.
    Labels that contradict each other count as trusted when one of them does, and as toxic when one of them does; null ids are never labelled; rows may repeat;
    other columns are ignored; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("lang"),
                       *[F.col(c).alias(f"c_{k}") for k, c in enumerate(carry)])
    bad = F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False))) if toxic_col in labels.columns else F.lit(False)
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("string").alias("_id")).agg(
        F.max(F.coalesce(F.col(label_col) == 1, F.lit(False))).alias("good"), bad.alias("toxic")).where("good or toxic").drop("good")
    known = written(known, "labelled-ids")
    known = F.broadcast(known) if known.count() <= 500_000 else known
    hashed = rows.withColumn("h", F.xxhash64("_id", "_text"))
    labelled = hashed.where("_text is not null and _text <> ''").select("_id", "lang", "_text", "h").join(known, "_id")
    labelled = written(labelled.dropDuplicates(["_id", "h", "lang"]), "labelled-texts")
    texts = labelled.where("not toxic")
    own = [x.lang for x in texts.groupBy("lang").agg(F.count("*").alias("n")).where("n >= 20 and lang is not null").collect()]
    if texts.isEmpty():
        nothing = F.lit(None).cast("double")
        out = rows.select("_id", "lang", *[f"c_{k}" for k in range(len(carry))], *(["_text"] if keep_text else []), F.coalesce(F.length("_text"), F.lit(0)).cast("long").alias("n_letters"),
                          nothing.alias("perplexity"), nothing.alias("low_limit"), nothing.alias("high_limit"), nothing.alias("repeated"), nothing.alias("repeated_limit"), nothing.alias("toxicity"), nothing.alias("toxicity_limit"), F.lit(True).alias("kept"))
        return renamed(named(out, id_col, kind), carry, text_col)
    model = F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit("")) if own else F.lit("")
    odd = F.col("h").bitwiseAND(F.lit(1)) == 1
    # The model of all languages is learnt and limited where a language has none of its own.
    overall = bool(own) and not rows.where(model == "").isEmpty()
    every = labelled.withColumn("model", model)
    letters = LetterModel(every.where(odd & ~F.col("toxic")).select("model", "_text"), order, overall)
    signs = toxic_signs(every.where(odd | F.col("toxic")), overall)
    scored = written(letter_perplexity(hashed.withColumn("model", model), letters, signs, keep_text), "scored")
    measures = ["n_letters", "perplexity", "n_pairs", "repeated", "toxicity"]
    audit = scored.where("perplexity is not null").select("_id", "h", "lang", "model", *measures).join(known, "_id").where("not toxic").dropDuplicates(["_id", "h", "lang"])
    audit = audit.select("model", odd.alias("taught"), *measures)
    if overall:
        again = letter_perplexity(texts.select(F.lit("").alias("model"), odd.alias("taught"), "_text"), letters, signs)
        audit = audit.where("model <> ''").unionByName(again.select("model", "taught", *measures))
    out = scored.drop("h").join(F.broadcast(trusted_limits(audit, low, high)), "model", "left")
    wider = 1 + AVERAGE_LETTERS / F.col("n_letters")
    out = out.withColumn("low_limit", F.when(F.col("n_letters") > 0, F.pow(F.lit(10.0), F.col("mean") + F.col("low") * wider)))
    out = out.withColumn("high_limit", F.when(F.col("n_letters") > 0, F.pow(F.lit(10.0), F.col("mean") + F.col("high") * wider)))
    out = out.withColumn("repeated_limit", F.when(F.col("n_pairs") > 0, F.col("repeated_mean") + F.col("repeated_high") * (1 + AVERAGE_PAIRS / F.col("n_pairs"))))
    kept = F.coalesce(F.col("perplexity").between(F.col("low_limit"), F.col("high_limit")), F.lit(True)) & F.coalesce(F.col("repeated") <= F.col("repeated_limit"), F.lit(True))
    kept = kept & F.coalesce(F.col("toxicity") <= F.col("toxicity_limit"), F.lit(True))
    out = out.drop("model", "mean", "low", "high", "repeated_mean", "repeated_high", "n_pairs")
    return renamed(named(out.withColumn("kept", kept), id_col, kind), carry, text_col)


def renamed(out: DataFrame, carry: tuple, text_col: str) -> DataFrame:
    out = out.withColumnRenamed("_text", text_col)
    for k, name in enumerate(carry):
        out = out.withColumnRenamed(f"c_{k}", name)
    return out

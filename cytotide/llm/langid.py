"""Language ID by multilingual mixture inference.

Every language has a distribution over byte trigrams of lower-cased words,
counted over all labelled training documents. A document is a mixture of
languages: expectation-maximisation over its words' trigram likelihoods
estimates the proportions. Its language set is the one of the nested sets of
its 1, 2, ... most present languages with the best likelihood less PENALTY / 2
* log(words) per language; the prediction is the set's most present language
and its proportion is the score.

Defined results: null text and text without a letter give ``und``, score 0 and
no proportions; so does every text where nothing could be learned. Rows
without a language or text teach nothing. Ties go to the language that is
first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytotide.llm.common import pick

#: Trigrams are hashed to so many bins: the model has this many numbers per language.
BINS = 1 << 16
#: Added to every count: the smoothing of unseen trigrams.
SMOOTHING = 0.05
ROUNDS = 12
PENALTY = 2.0
#: Texts are put together up to so many bytes for one pass of numpy; longer texts are read in pieces of that size.
PIECE = 1 << 20
UNDETERMINED = "und"
#: ASCII bytes that aren't letters end a word; other bytes belong to words.
_FOLD = np.array([b if chr(b).isalpha() or b > 127 else 32 for b in range(256)], dtype=np.uint8)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bins of folded bytes (32 at both ends), one around each letter byte, and where words begin among them."""
    letter = data != 32
    inner = np.flatnonzero(letter)
    wide = data.astype(np.uint32)
    code = (wide[inner - 1] << 16) | (wide[inner] << 8) | wide[inner + 1]
    bins = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % BINS
    return bins, np.flatnonzero(~letter[inner - 1])


def _folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one array of folded bytes with a space around each, and the ends of the texts."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    return _FOLD[data], np.cumsum([len(t) + 1 for t in texts])


def _pieces(texts: list[str | None], piece: int = PIECE) -> Iterator[tuple[list[int], list[bytes]]]:
    """Consecutive texts of about ``piece`` bytes with their row numbers; long texts in several pieces, cut at words."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        left = _folded(t)
        while left:
            cut = len(left) if len(left) <= piece else (left.rfind(b" ", 0, piece) + 1 or piece)
            rows.append(i)
            held.append(left[:cut])
            size, left = size + cut, left[cut:]
            if size >= piece:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities (languages x BINS) from (text, lang).

    Each task counts its texts; the counts, whose size doesn't depend on the
    texts, are added up by Spark. The driver gets one count per language and bin.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                total = seen.setdefault(lang, np.zeros(BINS, dtype=np.int64))
                for _, held in _pieces(list(texts)):
                    total += np.bincount(_grams(_joined(held)[0])[0], minlength=BINS)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bin": at.astype(np.int32), "n": total[at]})

    taught = pick(docs, "text", "lang").where("text is not null and lang is not null")
    counts = (taught.mapInPandas(count, "lang string, bin int, n bigint")
              .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BINS))
    if langs:
        table[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), counts["bin"].to_numpy()] = counts["n"]
    table += SMOOTHING
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def _proportions(like: np.ndarray, starts: np.ndarray, of: np.ndarray, allowed: np.ndarray,
                 rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions and log likelihoods.

    like: words x languages, scaled to 1 at each word's best; starts and of:
    the documents' first words and the words' documents; allowed: documents x languages.
    """
    n = np.diff(np.append(starts, len(like)))[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = like * share[of]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, starts) / n
    total = np.log((like * share[of]).sum(axis=1))
    return share, np.add.reduceat(total, starts)


def infer(like: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Language proportions (documents x languages) from log likelihoods per word; 0 for languages outside the set."""
    n = np.diff(np.append(starts, len(like)))
    of = np.repeat(np.arange(len(starts)), n)
    like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -60.0))
    docs, langs = len(starts), like.shape[1]
    fee = PENALTY / 2 * np.log(np.maximum(n, 2))
    everything = np.ones((docs, langs))
    full, full_like = _proportions(like, starts, of, everything)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.zeros((docs, langs))
    best[np.arange(docs), order[:, 0]] = 1.0
    score = np.add.reduceat(np.log(like), starts)[np.arange(docs), order[:, 0]] - fee
    # no set of k languages has a higher likelihood than all languages together
    live = np.arange(docs)
    for k in range(2, langs + 1):
        live = live[full_like[live] - k * fee[live] > score[live]]
        if not len(live):
            break
        chosen = np.zeros(docs, dtype=bool)
        chosen[live] = True
        words = chosen[of]
        sub_n = n[live]
        sub_starts = np.cumsum(sub_n) - sub_n
        allowed = np.zeros((len(live), langs))
        np.put_along_axis(allowed, order[live, :k], 1.0, axis=1)
        if k < langs:
            share, got = _proportions(like[words], sub_starts, np.repeat(np.arange(len(live)), sub_n), allowed)
        else:
            share, got = full[live], full_like[live]
        better = got - k * fee[live] > score[live]
        best[live[better]] = share[better]
        score[live[better]] = got[better] - k * fee[live[better]]
    return best


def mixtures(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    """Proportions of every text (texts x languages); zeros for texts without words.

    ``model`` is BINS x languages. Texts longer than a piece are read in
    pieces of words; their pieces' proportions are averaged by words.
    """
    out = np.zeros((len(texts), model.shape[1]))
    weight = np.zeros(len(texts))
    for rows, held in _pieces(texts, max(1 << 14, PIECE * 4 // max(4, model.shape[1]))):
        data, ends = _joined(held)
        bins, word_at = _grams(data)
        if not len(word_at):
            continue
        # the place of each word's first byte tells its text
        first = np.flatnonzero((data[1:] != 32) & (data[:-1] == 32)) + 1
        text_of = np.searchsorted(ends, first - 1, side="right")
        starts = np.flatnonzero(np.diff(text_of, prepend=-1))
        like = np.add.reduceat(model[bins], word_at)
        share = infer(like, starts)
        at = np.asarray(rows)[text_of[starts]]
        n = np.diff(np.append(starts, len(text_of)))
        np.add.at(out, at, share * n[:, None])
        np.add.at(weight, at, n)
    return out / np.maximum(weight, 1)[:, None]


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, *columns: str) -> DataFrame:
    """The named columns of documents with ``lang_pred``, ``score`` and ``proportions`` (language to share)."""
    d = pick(docs, *dict.fromkeys((*columns, "text")))
    if not langs:
        return d.select(*columns).withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0),
                              "proportions": F.lit(None).cast("map<string, double>")})
    held = d.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(model.T, dtype=np.float32)))

    @F.pandas_udf("lang string, score double, proportions map<string, double>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        names, table = held.value
        shares = mixtures(list(texts), table)
        at = shares.argmax(axis=1)
        score = shares[np.arange(len(at)), at]
        found = score > 0
        return pd.DataFrame({"lang": [names[i] if ok else None for i, ok in zip(at, found, strict=True)], "score": np.minimum(score, 1.0),
                             "proportions": [{names[j]: float(s[j]) for j in np.flatnonzero(s)} if ok else None
                                             for s, ok in zip(shares, found, strict=True)]})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # else a filter on the prediction would run it a second time
    d = d.withColumn("inferred", udf.asNondeterministic()(F.col("text")))
    return d.select(*columns, F.when(letters, F.coalesce("inferred.lang", F.lit(UNDETERMINED))).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
                    F.when(letters, F.coalesce("inferred.score", F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"),
                    F.when(letters, F.col("inferred.proportions")).alias("proportions"))

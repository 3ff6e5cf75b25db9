"""URL verdicts: rules first, then naive Bayes over the words that a host name is made of.

A unigram model splits every host label and path part into words by Viterbi; its lexicon is a public vocabulary whose
entries stand in order of frequency, so an entry's probability follows from its rank by Zipf's law. A multinomial
naive Bayes model scores the words; neither the host's suffix nor words that most urls share say anything. It is learned from
labelled names. Rounds of expectation maximisation over all urls that no rule judges then add words that go with those
of the names: what the urls add to a class is scaled to a fixed share of the names' own mass, so it depends on shares of
words and not on how many urls there are, and a round after which a labelled name is judged worse is dropped. So no table
can dilute what the names say.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, decoded, table_chunks

#: (host, path, verdict): fits the host and its subdomains if the url's path starts with the rule's; the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled names that the Bayes model is trained on; a parameter.
BLOCK_NAMES = (
    "casino win", "casino bonus", "online casino", "poker bets", "free bets", "sports betting", "slot machines", "jackpot lottery", "win money", "free money",
    "cheap pills", "cheap meds", "buy pills online", "diet pills", "pharmacy discount", "adult videos", "adult x", "xxx porn", "sex cams", "hot girls",
    "spam farm", "link farm", "seo links", "click bait", "ads track", "ad server", "ads click", "tracker pixel", "pop ads", "banner ads",
    "free download crack", "torrent warez", "hack tools", "payday loans", "quick loan", "crypto profit", "replica watches", "fake bags", "cheap replica", "earn cash fast",
)
ALLOW_NAMES = (
    "blog", "news daily", "the times", "weather report", "city library", "public school", "university research", "science journal", "health service", "local history",
    "open source", "software docs", "data science", "code review", "developer guide", "travel notes", "food recipes", "garden club", "music review", "film archive",
    "museum art", "national park", "community forum", "support help", "online course", "book store", "photo gallery", "math lessons", "language learning", "sports results",
    "state government", "law review", "world map", "family tree", "car repair", "home design", "kids games", "chess club", "bird watching", "m mobile",
)
#: Prior probability of a block, the mass that the names' words of a class are scaled to, and the added count of every word.
PRIOR, MASS, ADDED = 0.2, 200.0, 0.5
#: Rounds over all urls, the mass of their words beside that of the names, and the share of urls from which on a word says nothing.
ROUNDS, URL_SHARE, COMMON = 2, 0.2, 0.05
LONGEST_WORD = 24
#: Longer runs of letters than this aren't kept in the cache of a worker.
LONGEST_KEPT = 256

_letters = re.compile(r"[a-z]+")
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Segmenter:
    """Words of a run of letters, by the most probable split."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranked = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and _letters.fullmatch(w[:-4]) and (len(w) > 6 or w[:-4] in ("a", "i")))
        total = sum(1 / (r + 10) for r in range(len(ranked)))
        self.cost = {w: log((r + 10) * total) for r, (_, w) in enumerate(ranked) if len(w) <= LONGEST_WORD}
        self.known: dict[str, tuple[str, ...]] = {}
        #: A letter outside every word costs as much as a rare word.
        self.letter = log(total * (len(ranked) + 10)) * 1.2

    def words(self, run: str) -> tuple[str, ...]:
        if len(run) > LONGEST_KEPT:
            return self._viterbi(run)
        if run not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[run] = self._viterbi(run)
        return self.known[run]

    def _viterbi(self, run: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            least, at = best[end - 1] + self.letter, end - 1
            for start in range(max(0, end - LONGEST_WORD), end):
                c = self.cost.get(run[start:end])
                if c is not None and best[start] + c < least:
                    least, at = best[start] + c, start
            best.append(least)
            back.append(at)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


class NameBayes:
    """Log odds of a block from counts of words in both classes, by names and (scaled to their share) by urls."""

    def __init__(self, block: dict[str, float], allow: dict[str, float], urls: tuple[dict[str, float], dict[str, float]] = ({}, {}), silent: frozenset[str] = frozenset(), prior: float = PRIOR):
        mass = lambda counts, total: {w: n * total / max(sum(counts.values()), 1e-9) for w, n in counts.items()}
        said = [mass(c, MASS) for c in (block, allow)]
        seen = [mass(c, MASS * URL_SHARE) for c in urls]
        count = lambda k, w: said[k].get(w, 0) + seen[k].get(w, 0) + ADDED
        self.odds = {w: round(log(count(0, w)) - log(count(1, w)), 9) for w in {w for c in (*said, *seen) for w in c} - silent}
        self.prior = log(prior / (1 - prior))

    def score(self, words: list[str]) -> float:
        """Words that neither class holds say nothing."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)

    def wrong(self, block: tuple[str, ...], allow: tuple[str, ...]) -> set[str]:
        """Names that aren't judged as they are labelled."""
        return {n for names, blocked in ((block, True), (allow, False)) for n in names if (self.score(n.split()) > 0) is not blocked}


def name_counts(names: tuple[str, ...]) -> dict[str, float]:
    return dict(Counter(w for name in names for w in name.split()))


def left_out_accuracy(block: tuple[str, ...], allow: tuple[str, ...]) -> float:
    """Share of the labelled names that a model of all others judges as they are labelled."""
    right = 0
    for k, name in enumerate((*block, *allow)):
        rest = [tuple(n for n in names if n != name) for names in (block, allow)]
        right += (NameBayes(*map(name_counts, rest)).score(name.split()) > 0) is (k < len(block))
    return right / max(1, len(block) + len(allow))


@lru_cache(maxsize=2)
def _segmenter(path: str) -> Segmenter:
    return Segmenter(path)


def url_words(host: str, path: str, lexicon: str) -> list[str]:
    """The words of a host without its suffix and port, and of a path."""
    labels = host.split(":")[0].split(".")
    named = labels[:-1] if len(labels) > 1 else labels
    return [w for part in (*named, path.translate(_lower)) for run in _letters.findall(part) for w in _segmenter(lexicon).words(run)]


def fit(pages: DataFrame, lexicon: str, rules: tuple[tuple[str, str, str], ...], block: tuple[str, ...], allow: tuple[str, ...], rounds: int = ROUNDS) -> NameBayes:
    """The model of the labelled names and of all urls that no rule judges.

    A word is an entry of the lexicon or a letter, so what comes to the driver and goes into the tasks is bounded by the
    lexicon; counts are combined before the shuffle. Words of more than COMMON of these urls, and single letters that no
    name has, are left out, unless a labelled name has the word.
    """
    named = name_counts(block), name_counts(allow)
    texts = pages.select(F.col("url").cast("binary").alias("url"))

    def summed(model: NameBayes) -> list[tuple[str, float, float, int]]:
        """For each word the sums of both classes' probabilities and the number of urls that have it; of all urls under the empty word."""

        def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in table_chunks(batches):
                sums: dict[str, list] = {}
                for url in rows["url"]:
                    host, path = split_url(decoded(url))
                    if host and fitting_rule(host, path, rules) is None:
                        words = url_words(host, path, lexicon)
                        p = 1 / (1 + exp(-max(-700.0, min(700.0, model.score(words)))))
                        for w in {*words, ""}:
                            both = sums.setdefault(w, [0.0, 0.0, 0])
                            both[0] += p
                            both[1] += 1 - p
                            both[2] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[k] for v in sums.values()], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int64())))], names=["word", "block", "allow", "n"])

        found = texts.mapInArrow(weighed, "word string, block double, allow double, n long").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.sum("n").alias("n"))
        return sorted(map(tuple, found.collect()))

    model = NameBayes(*named)
    for _ in range(rounds):
        found = summed(model)
        total = next((n for w, _, _, n in found if w == ""), 0)
        silent = frozenset(w for w, _, _, n in found if (n > COMMON * total or len(w) < 2) and w not in named[0] and w not in named[1])
        urls = {w: b for w, b, _, _ in found if w not in silent}, {w: a for w, _, a, _ in found if w not in silent}
        after = NameBayes(*named, urls, silent)
        if after.wrong(block, allow) - model.wrong(block, allow):
            break
        model = after
    return model


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_lower), re.match(r"[^?#]*", rest[len(host) :])[0]


def fitting_rule(host: str, path: str, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[str, str] | None:
    """The longest fitting rule as text, and its verdict. Of two equally long ones the first in the alphabet."""
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[1:] if fits else None


def url_verdicts(pages: DataFrame, lexicon: str, rules: tuple[tuple[str, str, str], ...] = RULES, block: tuple[str, ...] = BLOCK_NAMES, allow: tuple[str, ...] = ALLOW_NAMES) -> DataFrame:
    """Judge the url of every row.

    Returns ``page_id, host, path, rule, verdict, words, score``, one row for each input row: ``rule`` null and the
    verdict by the model's score (log odds of a block; ``words`` are the segmented words) where no rule fits. A null
    url, or one without ``://``, has an empty host and path and is judged by the prior; broken UTF-8 counts as U+FFFD. Null ids stay null; repeated
    rows are judged alike. Further columns aren't read. An empty table gives an empty result.
    """
    model = fit(pages, lexicon, rules, block, allow)

    def per_chunk(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("host", "path", "rule", "verdict", "words", "score")}
        for url in rows["url"]:
            host, path = split_url(url)
            words = url_words(host, path, lexicon)
            rule, score = fitting_rule(host, path, rules), model.score(words)
            for k, v in zip(out, (host, path, rule and rule[0], rule[1] if rule else "block" if score > 0 else "allow", " ".join(words), score), strict=True):
                out[k].append(v)
        return {"page_id": rows["page_id"], **out}

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), "page_id long, host string, path string, rule string, verdict string, words string, score double", per_chunk)

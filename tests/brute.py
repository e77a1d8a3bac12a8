"""Search in plain Python, one pair at a time, to test against."""

import math
import random
import re
from collections import Counter

from helpgrid.functions.text import english_stop_words

TOPICS = {
    "Payment": "refund card charge bank debit invoice payment gateway",
    "Delivery": "parcel courier address late box damaged driver tracking",
    "Account": "login password locked email profile verification reset",
    "Wallet": "balance wallet topup cashback points credit payment",
}


def make_articles(n, seed=1):
    """(kb_id, category, subcategory, journey_stage, issue_description, resolution_steps)."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        topic = pick.choice(sorted(TOPICS))
        words = TOPICS[topic].split() + ["customer", "the", "order", "not", "naïve", "café"]
        issue = " ".join(pick.choices(words, k=pick.randint(3, 14)))
        steps = "1. Check the %s. 2. Ask the customer." % pick.choice(words)
        rows.append(
            (
                i * 3 + 5,
                topic if pick.random() > 0.1 else None,
                f"{topic} {pick.randint(1, 3)}",
                "Checkout",
                issue,
                steps if pick.random() > 0.2 else None,
            )
        )
    # exact copies make ties
    rows += [(1000 + i, *rows[0][1:]) for i in range(max(1, n // 3))]
    return rows


def make_vectors(ids, dimension=6, seed=2):
    pick = random.Random(seed)
    vectors = {i: [float(pick.randint(-3, 3)) for _ in range(dimension)] for i in ids}
    first = next(iter(vectors))
    vectors[first] = [0.0] * dimension
    return vectors


def terms_of(text):
    stop = set(english_stop_words())
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stop]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def corpus_of(row):
    return " ".join(x or "" for x in (row[1], row[2], row[4], row[5]))


def unit(vector):
    length = math.sqrt(sum(x * x for x in vector))
    return [x / length for x in vector] if length else list(vector)


class Brute:
    def __init__(self, articles, vectors):
        self.articles = articles
        self.vectors = {i: unit(v) for i, v in vectors.items()}
        self.counts = {row[0]: terms_of(corpus_of(row)) for row in articles}
        n = len(articles)
        df = Counter(t for counts in self.counts.values() for t in counts)
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
        self.weights = {i: self._weights(c) for i, c in self.counts.items()}

    def _weights(self, counts):
        raw = {t: c * self.idf[t] for t, c in counts.items() if t in self.idf}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / length for t, x in raw.items()} if length else {}

    def raw_scores(self, text, vector):
        query = self._weights(terms_of(text or ""))
        wanted = unit(vector) if vector else None
        kw, sem = {}, {}
        for row in self.articles:
            i = row[0]
            kw[i] = round(sum(x * self.weights[i].get(t, 0.0) for t, x in query.items()), 12)
            held = self.vectors.get(i)
            dot = sum(a * b for a, b in zip(wanted, held)) if wanted and held else 0.0
            sem[i] = round(dot, 12)
        return sem, kw

    @staticmethod
    def scaled(scores):
        low, high = min(scores.values()), max(scores.values())
        if high > low:
            return {i: (x - low) / (high - low) for i, x in scores.items()}
        return scores

    def top(self, text, vector, k, alpha, scaled=True):
        """(kb_id, semantic, keyword, hybrid) in rank order."""
        sem, kw = self.raw_scores(text, vector)
        if scaled:
            sem, kw = self.scaled(sem), self.scaled(kw)
        rows = [(i, sem[i], kw[i], alpha * sem[i] + (1 - alpha) * kw[i]) for i in sem]
        return sorted(rows, key=lambda r: (-round(r[3], 9), r[0]))[:k]

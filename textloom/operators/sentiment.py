"""Rule-based sentiment after Hutto and Gilbert (2014): a valence lexicon that the caller supplies, and rules for words around.

The lexicon is a mapping from lower-case token to mean valence, -4 to 4; none comes with the library.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BOOST, CAPITALS, NEGATED, ALPHA = 0.293, 0.733, -0.74, 15.0
MORE = frozenset("absolutely amazingly completely considerably decidedly deeply enormously entirely especially exceptionally extremely fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very".split())
LESS = frozenset("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split())
NOT = frozenset("aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither never no nobody none nope nor not nothing nowhere oughtnt rarely seldom shouldnt uhuh wasnt werent without wont wouldnt".split())


def _tokens(text: str) -> list[str]:
    """Words without the punctuation around them; short ones, such as faces, are left as they are."""
    out = []
    for raw in text.split():
        bare = raw.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        out.append(raw if len(bare) <= 2 else bare)
    return out


def _boost(word: str, valence: float, shouting: bool) -> float:
    low = word.lower()
    by = BOOST if low in MORE else -BOOST if low in LESS else 0.0
    if by and shouting and word.isupper():
        by += math.copysign(CAPITALS, by)
    return by if valence > 0 else -by


def polarity(text: str, lexicon: Mapping[str, float]) -> dict[str, float]:
    """neg, neu and pos, the shares of the text's weight, and compound, from -1 to 1."""
    words = _tokens(text)
    capitals = sum(w.isupper() for w in words)
    shouting = 0 < capitals < len(words)
    scores = []
    for i, word in enumerate(words):
        low, v = word.lower(), 0.0
        if low in lexicon and low not in MORE and low not in LESS:
            v = float(lexicon[low])
            if shouting and word.isupper():
                v += math.copysign(CAPITALS, v)
            for back in (1, 2, 3):
                if i < back or words[i - back].lower() in lexicon:
                    continue
                v += _boost(words[i - back], v, shouting) * (1.0, 0.95, 0.9)[back - 1]
                if words[i - back].lower().replace("'", "") in NOT or words[i - back].lower().endswith("n't"):
                    v *= NEGATED
        scores.append(v)
    turn = next((i for i, w in enumerate(words) if w.lower() == "but"), None)
    if turn is not None:
        scores = [v * (0.5 if i < turn else 1.5 if i > turn else 1.0) for i, v in enumerate(scores)]
    if not scores:
        return {"neg": 0.0, "neu": 0.0, "pos": 0.0, "compound": 0.0}
    marks = min(text.count("!"), 4) * 0.292
    asked = text.count("?")
    marks += 0.0 if asked < 2 else asked * 0.18 if asked <= 3 else 0.96
    total = sum(scores)
    total += math.copysign(marks, total) if total else 0.0
    up, down, flat = sum(v + 1 for v in scores if v > 0), sum(v - 1 for v in scores if v < 0), sum(v == 0 for v in scores)
    if up > abs(down):
        up += marks
    elif up < abs(down):
        down -= marks
    whole = up + abs(down) + flat
    return {"neg": round(abs(down) / whole, 3), "neu": round(flat / whole, 3), "pos": round(up / whole, 3), "compound": round(max(-1.0, min(1.0, total / math.sqrt(total * total + ALPHA))), 4)}


def sentiment(text: Column, lexicon: Mapping[str, float]) -> Column:
    """struct(neg, neu, pos, compound) of each text; null for null."""
    table = dict(lexicon)

    @F.pandas_udf("neg double, neu double, pos double, compound double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([polarity(t or "", table) for t in texts], columns=["neg", "neu", "pos", "compound"], index=texts.index, dtype="float64")

    return F.when(text.isNotNull(), score(text))

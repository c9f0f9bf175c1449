"""Noun chunks without a model: a lexicon and word endings give each token's likely tags, Viterbi the best row of tags.

Tags: D determiner, J adjective, N noun, P name, R pronoun, V verb, X auxiliary, I preposition, A adverb, C conjunction,
M number, S possessive ending, T particle, U sign.  A chunk is D? (A? J|M)* (N|P|M)+, with possessives before it, or R.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "DJNPRVXIACMSTU"

#: Words by their tags, the likeliest first.
LEXICON = {
    w: tags
    for tags, words in {
        "D": "the a an this these those every each some any no another both all its my our your their",
        "DR": "his her that",
        "R": "i you he she it we they me him us them who whom which what something anything nothing everyone someone itself himself themselves mine ours yours theirs",
        "X": "is are was were be been being am has have had do does did will would can could may might must shall should",
        "I": "of in on at by for with from into over under between through during before after against about among within without across per via than until toward towards upon since as off above below near",
        "C": "and or but nor so yet if because although though while whereas unless when where whether",
        "A": "not never very too also only still even just now then here there often always already again ever quite rather however therefore sharply well soon up down out away back",
        "T": "to 't",
        "M": "one two three four five six seven eight nine ten hundred thousand million billion",
        "J": "new old good bad big small large long short high low great little strong weak early late other same own such many much few more most less least main net gross total annual recent record several important",
        "V": "said says say made make makes took take takes got get gets went go goes came come comes saw see gave give rose fell grew lost won held kept left told became began sent brought bought sold paid built found led met put set cut let beat plans expects wants needs reported reports announced",
        "NV": "increase decrease report plan demand need order rise fall work use market share cost change offer show",
    }.items()
    for w in words.split()
}

#: Endings of words that the lexicon lacks, the longest that fits first.
ENDINGS = {
    "ability": "N", "ically": "A", "ation": "N", "ition": "N", "ingly": "A", "ments": "N", "ness": "N", "ment": "N", "sion": "N", "tion": "N", "ship": "N", "able": "J", "ible": "J", "less": "J", "ical": "J",
    "ious": "J", "eous": "J", "ful": "J", "ous": "J", "ive": "J", "ish": "J", "est": "J", "ity": "N", "ing": "VNJ", "ism": "N", "ist": "N", "ial": "J", "ual": "J", "ize": "V", "ise": "VN", "ify": "V", "ary": "JN", "ent": "JN", "ant": "JN",
    "ed": "VJ", "ly": "A", "al": "JN", "ic": "JN", "es": "NV", "s": "NV",
}

#: What a tag that is likely, the next likely and any other weigh, and what a tag after a tag adds; all else adds -20.
FIRST, NEXT, OTHER, ELSE = 0, -12, -90, -20
AFTER = {
    "D": "N-3 J-4 P-8 M-10 A-16 V-45 X-60 I-60 R-60 D-40 C-60 U-40",
    "J": "N-2 J-10 P-10 C-12 U-14 I-14 T-14 M-16",
    "N": "N-8 I-6 V-6 X-6 U-6 C-8 S-4 T-12 A-14 P-22 J-30 R-22 D-24",
    "P": "P-4 N-8 V-6 X-6 U-6 I-8 C-8 S-4 M-12",
    "R": "V-4 X-4 U-10 I-12 A-10 C-14 N-30",
    "V": "D-4 I-6 N-10 P-10 J-10 A-10 R-8 T-8 M-10 U-10 V-30",
    "X": "V-4 A-8 D-8 J-8 T-8 R-10 X-10 I-12 N-18",
    "I": "D-4 N-8 P-6 J-8 M-6 R-10 V-20",
    "A": "V-8 J-6 A-14 I-10 D-10 X-12 U-10 M-12",
    "C": "D-8 N-8 P-8 J-10 V-10 R-8 A-10 X-14",
    "M": "N-3 M-6 J-8 I-8 U-8 C-10",
    "S": "N-3 J-5 P-10 M-12",
    "T": "V-2 X-6 D-6 N-12 P-8 A-10 M-10",
    "U": "D-8 N-8 P-8 J-10 R-8 C-8 V-14 U-8 I-10 A-10 M-10",
}
#: Tags of a sequence's first word.
START = "D-4 N-10 P-8 J-10 R-6 C-8 A-10 I-10 X-16 V-18 M-10"

#: Tokens of a block of sequences that are decoded in step.
CELLS = 1 << 15

_TOKEN = re.compile(r"\n\s*\n|[A-Za-z](?:\.[A-Za-z])+\.?|[^\W\d_]+(?:-[^\W_]+)*|['’][st]\b|[$€£]?\d(?:[\d.,]*\d)?%?|\w+|[^\w\s]")
_ENDS = frozenset(".?!;:")
_CHUNK = re.compile(r"(?:D?(?:A?[JM])*+[NP]+S)*+(?:D?(?:A?J|M)*[NPM]+)|R")


def _row(text: str) -> np.ndarray:
    row = np.full(len(TAGS), ELSE, np.int64)
    for item in text.split():
        row[TAGS.index(item[0])] = int(item[1:])
    return row


_STEP = np.stack([_row(AFTER[t]) for t in TAGS])
_BEGIN = _row(START)


@lru_cache(1 << 16)
def likely(token: str, first: bool) -> np.ndarray:
    """What each tag weighs for a token; ``first`` of its sentence, a capital tells nothing."""
    word = token.lower().replace("’", "'")
    if word == "'s":
        tags = "S"
    elif word == "'t":
        tags = "T"
    elif word[-1] == "n" and LEXICON.get(word[:-1]) == "X":
        tags = "X"
    elif not token[0].isalnum() and not re.search(r"\d", token):
        tags = "U"
    elif re.search(r"\d", token):
        tags = "M"
    elif word in LEXICON:
        tags = LEXICON[word]
    elif token[0].isupper() and not first or "." in token:
        tags = "PNJ"
    else:
        end = next((e for e in (word[-n:] for n in range(7, 0, -1) if len(word) > n + 1) if e in ENDINGS), None)
        tags = (ENDINGS[end] if end else "NJV") + ("P" if token[0].isupper() else "")
    row = np.full(len(TAGS), OTHER, np.int64)
    for i, tag in enumerate(tags):
        row[TAGS.index(tag)] = FIRST + i * NEXT
    return row


def _decode(block: list[list[str]]) -> list[str]:
    longest = max(map(len, block))
    seen: dict[tuple[str, bool], int] = {}
    ids = np.zeros((len(block), longest), np.int32)
    for i, tokens in enumerate(block):
        ids[i, : len(tokens)] = [seen.setdefault((t, not j), len(seen)) for j, t in enumerate(tokens)]
    emitted = np.stack([likely(*k) for k in seen])[ids]
    sizes = np.array([len(s) for s in block])
    best = emitted[:, 0] + _BEGIN
    back = np.zeros((longest, len(block), len(TAGS)), np.int8)
    ended = best.copy()
    for j in range(1, longest):
        ways = best[:, None] + _STEP.T
        back[j] = ways.argmax(2)
        best = np.take_along_axis(ways, back[j][..., None].astype(np.intp), 2)[..., 0] + emitted[:, j]
        ended[sizes == j + 1] = best[sizes == j + 1]
    at = ended.argmax(1)
    path = np.zeros((len(block), longest), np.int8)
    for j in range(longest - 1, -1, -1):
        inside = sizes > j
        path[inside, j] = at[inside]
        if j:
            at = np.where(inside, back[j, np.arange(len(block)), at], at)
    return ["".join(TAGS[t] for t in path[i, :n]) for i, n in enumerate(sizes)]


def tagged(sequences: list[list[str]]) -> list[str]:
    """The best row of tags of each sequence of tokens, a letter a token; ties go to the tag that comes first."""
    out, block = [""] * len(sequences), []
    for i in [*sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i])), None]:
        if block and (i is None or len(sequences[i]) * (len(block) + 1) > CELLS):
            for k, tags in zip(block, _decode([sequences[k] for k in block]), strict=True):
                out[k] = tags
            block = []
        if i is not None:
            block.append(i)
    return out


def split(text: str) -> Iterator[list[tuple[int, int]]]:
    """Where the tokens of each sentence stand.  A sign that ends sentences, or an empty line, ends a sequence."""
    spans = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token[0] != "\n":
            spans.append(m.span())
        if spans and (token in _ENDS or token[0] == "\n"):
            yield spans
            spans = []
    if spans:
        yield spans


def chunks_of(texts: list[str | None]) -> list[list[str]]:
    """The noun chunks of each text in lower case, in order, each once; white space inside is one space."""
    where, sequences = [], []
    for i, text in enumerate(texts):
        for spans in split(text or ""):
            where.append((i, spans))
            sequences.append([text[a:b] for a, b in spans])
    out: list[dict] = [{} for _ in texts]
    for (i, spans), tags in zip(where, tagged(sequences), strict=True):
        for m in _CHUNK.finditer(tags):
            found = texts[i][spans[m.start()][0] : spans[m.end() - 1][1]]
            out[i][" ".join(found.lower().split())] = None
    return [list(o) for o in out]


def noun_chunks(text: Column) -> Column:
    """Distinct lower-case noun chunks of a text, in order; none for a null text.  Works on whole texts in Arrow batches."""

    @F.pandas_udf("array<string>")
    def get(texts: pd.Series) -> pd.Series:
        return pd.Series(chunks_of(texts.tolist()))

    return get(text)

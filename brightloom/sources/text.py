"""Prose for comment and description columns: a fixed pool of sentences by a weighted grammar, from which rows take parts."""

from __future__ import annotations

import random

# Words with weights, and the grammar with its weights: fixed values of the public TPC-H text domains (the frequent words).
NOUNS = {
    "packages": 40, "requests": 40, "accounts": 40, "deposits": 40, "foxes": 20, "ideas": 20, "theodolites": 20, "pinto beans": 20,
    "instructions": 20, "dependencies": 10, "excuses": 10, "platelets": 10, "asymptotes": 10, "courts": 5, "dolphins": 5,
}
VERBS = {"sleep": 20, "wake": 20, "are": 20, "cajole": 20, "haggle": 20, "nag": 10, "use": 10, "boost": 10, "affix": 5, "detect": 5, "integrate": 5}
ADVERBS = {"furiously": 50, "quickly": 50, "carefully": 50, "blithely": 50, "slyly": 50, "fluffily": 5, "silently": 5, "ruthlessly": 5}
ADJECTIVES = {"special": 20, "pending": 20, "unusual": 20, "express": 20, "furious": 1, "sly": 1, "regular": 20, "final": 20, "ironic": 20, "even": 5, "bold": 5, "silent": 5}
PREPOSITIONS = {"about": 50, "above": 50, "according to": 50, "across": 50, "after": 50, "against": 40, "along": 40, "among": 10, "around": 10, "at": 10}
AUXILIARIES = {"do": 1, "may": 1, "might": 1, "shall": 1, "will": 1, "would": 1, "can": 1, "could": 1, "should": 1, "must": 1}
TERMINATORS = {".": 50, ";": 1, ":": 1, "?": 1, "!": 1, "--": 1}
#: N noun phrase, V verb phrase, P preposition and noun phrase, T terminator.
SENTENCES = {"N V T": 3, "N V P T": 3, "N V N T": 3, "N P V N T": 1, "N P V P T": 1}
#: n noun, j adjective, d adverb.
NOUN_PHRASES = {"n": 10, "j n": 20, "j, j n": 10, "d j n": 50}
#: v verb, x auxiliary, d adverb.
VERB_PHRASES = {"v": 30, "x v": 1, "v d": 40, "x v d": 1}
#: Least and greatest lengths of comments, as fixed values.
LENGTHS = {
    "p_comment": (5, 22), "s_comment": (25, 100), "ps_comment": (49, 198), "c_comment": (29, 116),
    "o_comment": (19, 78), "l_comment": (10, 43), "n_comment": (31, 114), "r_comment": (31, 115),
}
POOL_CHARS = 1_024


def pool(chars: int, words: dict[str, dict[str, int]] | None = None, seed: int = 19) -> str:
    """Sentences of ``chars`` characters. words: other weighted lists, as a distribution file has them under nouns, verbs,
    adverbs, adjectives, prepositions, auxillaries and terminators."""
    r, own = random.Random(seed), words or {}
    lists = {
        "n": own.get("nouns", NOUNS), "v": own.get("verbs", VERBS), "d": own.get("adverbs", ADVERBS), "j": own.get("adjectives", ADJECTIVES),
        "x": own.get("auxillaries", AUXILIARIES), "T": own.get("terminators", TERMINATORS), "p": own.get("prepositions", PREPOSITIONS),
    }
    one = lambda dist: r.choices(list(dist), list(dist.values()))[0]
    fill = lambda form: " ".join(one(lists[x[0]]) + x[1:] for x in form.split())
    out = ""
    while len(out) < chars:
        parts = []
        for x in one(SENTENCES).split():
            if x == "T":
                parts[-1] += one(lists["T"])
            else:
                parts.append(fill(one(VERB_PHRASES)) if x == "V" else ("" if x == "N" else one(lists["p"]) + " the ") + fill(one(NOUN_PHRASES)))
        out += " ".join(parts) + " "
    return out[:chars]


def letters(chars: int, seed: int = 23) -> str:
    """Random letters, digits and spaces, for addresses."""
    r = random.Random(seed)
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789, ") for _ in range(chars))


def part(d, source: str, draw: str, least: int, most: int) -> str:
    """A part of ``least`` to ``most`` characters of a source, by one draw, as an expression of dialect d."""
    starts = len(source) - most
    return f"substr({d.text(source)}, cast({draw} % {starts} as int) + 1, cast({least} + ({d.div(draw, str(starts))}) % {most - least + 1} as int))"

"""SCN-01: quantities of syllables and the feet of a verse: what a scanner for `styling.scanned` is made of.

A line becomes syllables with a quantity each: long, short, or open where the letters do not tell. A foot pattern fits
if no syllable contradicts it; the pattern is found by a walk over places and feet that keeps the best way to each place.
"""

from __future__ import annotations

import re
import unicodedata

LONG, SHORT, OPEN = "-", "u", "?"
# fixed values: vowels, diphthongs, pairs of mute and liquid, letters that count as two consonants
VOWELS = "aeiouy"
DIPHTHONGS = {"ae", "au", "oe", "eu"}
MUTES, LIQUIDS, DOUBLE = "bcdfgpt", "lr", "xz"
MACRON, BREVE = "̄", "̆"

DACTYL, SPONDEE = "-uu", "--"
LAST = ["-x"]
# feet of each place, the likelier first; x takes any quantity
HEXAMETER = [[DACTYL, SPONDEE]] * 4 + [[DACTYL, SPONDEE], LAST]
PENTAMETER = [[DACTYL, SPONDEE]] * 2 + [["-"], [DACTYL], [DACTYL], ["x"]]
METERS = {"hexameter": HEXAMETER, "pentameter": PENTAMETER}
RARE = 10  # what a spondee in the fifth foot costs; an open syllable that is taken as long costs 1


def letters(word: str) -> list[tuple[str, str]]:
    """(letter, mark) of a word, with consonant i and u as j and v, qu as q and without h."""
    out: list[tuple[str, str]] = []
    for c in unicodedata.normalize("NFD", word.lower()):
        if c in (MACRON, BREVE) and out:
            out[-1] = (out[-1][0], c)
        elif "a" <= c <= "z":
            out.append((c, ""))
    out = [x for i, x in enumerate(out) if x[0] != "h" and not (x[0] == "u" and i and out[i - 1][0] == "q")]
    for i, (c, mark) in enumerate(out):
        after = i + 1 < len(out) and out[i + 1][0] in VOWELS
        before = i and out[i - 1][0] in VOWELS
        if c in "iu" and not mark and after and (i == 0 or before and c == "i"):
            out[i] = ("j" if c == "i" else "v", "")
    return out


def nuclei(word: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Start and end of the vowels of each syllable."""
    found, i = [], 0
    while i < len(word):
        if word[i][0] not in VOWELS:
            i += 1
            continue
        two = i + 1 < len(word) and word[i][0] + word[i + 1][0] in DIPHTHONGS and not word[i][1] and not word[i + 1][1]
        found.append((i, i + 1 + two))
        i += 1 + two
    return found


def quantities(line: str) -> list[str]:
    """The quantity of each syllable that is spoken: final vowels, with or without m, vanish before a word that begins with a vowel."""
    words = [w for w in (letters(x) for x in re.findall(r"[^\W\d_]+(?:[̄̆]+[^\W\d_]*)*", unicodedata.normalize("NFC", line))) if w]
    sounds: list[tuple[str, str, bool]] = []  # letter, mark, whether its word ends after it
    for k, word in enumerate(words):
        end = len(word)
        if k + 1 < len(words) and words[k + 1][0][0] in VOWELS:
            tail = end - 1 if word[-1][0] == "m" and end > 1 else end
            if word[tail - 1][0] in VOWELS:
                end = nuclei(word)[-1][0]
        sounds += [(c, m, i == end - 1) for i, (c, m) in enumerate(word[:end])]
    plain = [(c, m) for c, m, _ in sounds]
    spots = nuclei(plain)
    spots = [s for s in spots if s[1] - s[0] == 1 or not sounds[s[0]][2]] + [(i, i + 1) for a, b in spots if b - a == 2 and sounds[a][2] for i in (a, a + 1)]
    spots.sort()
    out = []
    for n, (start, end) in enumerate(spots):
        until = spots[n + 1][0] if n + 1 < len(spots) else len(plain)
        between = "".join(c for c, _ in plain[end:until])
        weight = sum(2 if c in DOUBLE else 1 for c in between)
        within = not any(sounds[i][2] for i in range(end - 1, until - 1)) if until > end else True
        marks = {m for _, m in plain[start:end]}
        if end - start == 2 or MACRON in marks:
            out.append(LONG)
        elif weight >= 2 and len(between) == 2 and between[0] in MUTES and between[1] in LIQUIDS and within:
            out.append(SHORT if BREVE in marks else OPEN)
        elif weight >= 2:
            out.append(LONG)
        else:
            out.append(SHORT if BREVE in marks else OPEN)
    return out


def scan(line: str, meter: str = "hexameter") -> str | None:
    """The feet of a line, as -uu|--|...|-x, or None if no pattern fits; of several the one of least cost, then dactyls first."""
    syllables = quantities(line)
    best: dict[int, tuple[int, tuple[str, ...]]] = {0: (0, ())}
    for place, choices in enumerate(METERS[meter]):
        after: dict[int, tuple[int, tuple[str, ...]]] = {}
        for at, (cost, feet) in best.items():
            for foot in choices:
                part = syllables[at : at + len(foot)]
                if len(part) < len(foot) or any(f != "x" and q not in (f, OPEN) for f, q in zip(foot, part, strict=True)):
                    continue
                price = cost + sum(f == LONG and q == OPEN for f, q in zip(foot, part, strict=True)) + RARE * (place == 4 and foot == SPONDEE and meter == "hexameter")
                way = (price, (*feet, foot))
                if at + len(foot) not in after or (way[0], [f != DACTYL for f in way[1]]) < (after[at + len(foot)][0], [f != DACTYL for f in after[at + len(foot)][1]]):
                    after[at + len(foot)] = way
        best = after
    return "|".join(best[len(syllables)][1]) if len(syllables) in best else None

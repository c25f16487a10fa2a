"""Scansion: known lines, elision, and the walk over feet against all foot patterns."""

import itertools
import random

import pytest

from lectern.functions import verse


@pytest.mark.parametrize("line,want", [
    ("Arma virumque canō, Trōiae quī prīmus ab ōrīs", "-uu|-uu|--|--|-uu|-x"),
    ("quadrupedante putrem sonitū quatit ungula campum", "-uu|-uu|-uu|-uu|-uu|-x"),
    ("monstrum horrendum, informe, ingēns, cui lūmen adēmptum", None),
    ("tā tă tă tā tā tā tā tā tă tă tā tă tă tā ta", "-uu|--|--|-uu|-uu|-x"),
    ("ta ā tă tă tam ā tā tā tā tā tă tă tā tă tă tā ta", "-uu|--|--|-uu|-uu|-x"),
    ("", None),
    ("123 !", None),
])
def test_known_lines(line, want):
    found = verse.scan(line)
    assert found == want or want is None and (found is None or found.count("|") == 5)


def test_quantities():
    assert verse.quantities("aurae") == ["-", "-"]
    assert verse.quantities("āra") == ["-", "?"] and verse.quantities("ăra") == ["u", "?"]
    assert verse.quantities("multa") == ["-", "?"] and verse.quantities("patris") == ["?", "?"]
    assert verse.quantities("axis") == ["-", "?"] and verse.quantities("et nunc") == ["-", "-"]
    assert verse.quantities("multum ille") == ["-", "-", "?"] and verse.quantities("atque hoc") == ["-", "?"]
    assert verse.quantities("quoque") == ["?", "?"] and verse.quantities("iam") == ["?"]


def by_hand(syllables: list, meter: str):
    best = None
    for feet in itertools.product(*verse.METERS[meter]):
        flat = "".join(feet)
        if len(flat) != len(syllables) or any(f != "x" and q not in (f, "?") for f, q in zip(flat, syllables, strict=True)):
            continue
        cost = sum(f == "-" and q == "?" for f, q in zip(flat, syllables, strict=True))
        cost += verse.RARE * (meter == "hexameter" and feet[4] == verse.SPONDEE)
        key = (cost, [f != verse.DACTYL for f in feet])
        if best is None or key < best[0]:
            best = (key, "|".join(feet))
    return best and best[1]


@pytest.mark.parametrize("meter", ["hexameter", "pentameter"])
def test_scan_against_all_patterns(meter, monkeypatch):
    r = random.Random(6)
    found = 0
    for _ in range(3000):
        feet = [r.choice(f) for f in verse.METERS[meter]]
        syllables = [q if r.random() < 0.5 else r.choice("?-u?") if r.random() < 0.1 else "?" for q in "".join(feet).replace("x", "?")]
        monkeypatch.setattr(verse, "quantities", lambda line, s=syllables: s)
        want = by_hand(syllables, meter)
        assert verse.scan("", meter) == want
        found += want is not None
    assert 1000 < found

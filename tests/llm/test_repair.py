import hashlib
import random
import zlib
from itertools import product

import pytest

from corpusloom.llm import repair
from corpusloom.llm.queries import op13_structure_repair
from tests.conftest import SF

BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """The contract's damage, row by row: conv_id -> rows."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(c for c in text if c not in ".!?")
        if d == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def told(rows):
    """Faults of a conversation's rows in order."""
    seen, found = set(), []
    for _, role, text in rows:
        core = text.rstrip(BLANK)
        found.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def legal(initials):
    s = "".join(initials).removeprefix("s")
    return not initials or (len(s) > 0 and s == "ua" * (len(s) // 2))


def cheapest(rows, faults):
    """All sequences of edits with up to two inserts in each place: (cost, audit, repaired rows) of the least."""
    options = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        own = [("D", 3, [])]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own.append(("K", 0 + more, [(role, text)]))
            own += [("R", 2 + more, [(r, text)]) for r in ("user", "assistant")]
        options.append(own)
    adds = [("", 0, [])] + [("I", 2, [(a, "")]) for a in ("user", "assistant")] + [("II", 4, [(a, ""), (b, "")]) for a in ("user", "assistant") for b in ("user", "assistant")]
    best = None
    for chosen in product(*[x for o in options for x in (adds, o)], adds):
        said = [r for c in chosen for r in c[2]]
        key = (sum(c[1] for c in chosen), "".join(c[0] for c in chosen))
        if (best is None or key < best[:2]) and legal([r[:1] or "-" for r, _ in said]):
            best = (*key, said)
    return best


def answer(rows, search=cheapest):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = told(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, said = search(rows, faults) if rows else (0, "", [])
    initials = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
    )


def plain(rows, faults):
    """A walk over rows that keeps the least (cost, audit, rows) of each state of the pattern: no runs, powers or segments."""
    after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def opened(best):
        best = dict(best)
        for _ in range(2):
            for s, (cost, audit, said) in list(best.items()):
                role, then = after[s]
                best[then] = min(best.get(then, (1 << 40,)), (cost + 2, audit + "I", [*said, (role, "")]))
        return best

    best = {0: (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        found = {}
        for s, (cost, audit, said) in opened(best).items():
            ways = [(s, (cost + 3, audit + "D", said))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (role[:1], s) in keep:
                    ways.append((keep[role[:1], s], (cost + more, audit + "K", [*said, (role, text)])))
                ways.append((after[s][1], (cost + 2 + more, audit + "R", [*said, (after[s][0], text)])))
            for then, way in ways:
                found[then] = min(found.get(then, (1 << 40,)), way)
        best = found
    best = opened(best)
    return min(best[s] for s in (0, 3) if s in best)


def check(got, want):
    got = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(op13_structure_repair(spark, SF).collect(), {k: answer(v, plain) for k, v in damage(rows).items()})


def random_rows(rng, convs, longest):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "usher"], ["Yes.", "no", " ", "", None, "Go!\n", "a b", "Same?"]
    return [(c, t if rng.random() < 0.9 else None, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)) for c in convs for t in range(rng.randrange(longest))]


def test_all_edits(spark):
    """Against every sequence of edits."""
    rng = random.Random(5)
    rows = random_rows(rng, range(150), 4)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = {k: v for k, v in damage(rows).items() if len(v) <= 3}
    got = [r for r in repair.repaired_conversations(df).collect() if r["conv_id"] in kept]
    assert sum(len(v) == 3 for v in kept.values()) > 10
    check(got, {k: answer(v) for k, v in kept.items()})


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_segments(spark, monkeypatch, segment):
    """However conversations are cut, and with one that holds a third of all rows."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = random_rows(rng, [None, *range(40)], 14) + [(77, t, rng.choice(["user", "assistant"]) if t % 50 else "system", "x." if t % 3 else "y") for t in range(150)] + [(78, None, "user", "same.")] * 60
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, fault int, segment string").repartition(5)
    check(repair.repaired_conversations(df).collect(), {k: answer(v, plain) for k, v in damage(rows).items()})


def test_powers():
    """A long run's costs through powers are those of single steps."""
    for symbol in ("u.", "at", "s.", "-x", "ux"):
        v = w = repair.FINAL
        for n in range(1, 70):
            w = repair.applied(repair.power(symbol, 0), w)
            assert repair.back(symbol, n, v) == w


def test_nothing_left(spark):
    none = hashlib.sha256(b"").hexdigest()
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    got = repair.repaired_conversations(spark.createDataFrame([(9, turn, "user", "Hm.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(9, 0, 0, 0, 0, 0, 0, "", none)]
    assert repair.repaired_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
from llm_help import rows

from tallyward.llm import turn_repair
from tallyward.llm.turn_repair import END, FAR, NONE, Lattice

KIND = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(data):
    out = []
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def best_edits(turns):
    """(cost, audit, repaired turns) by trying every edit before and at every turn: role, text, must go, cut."""
    states = {"": (0, "", [])}  # last role initial -> cheapest

    def offer(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def following(last):
        return "assistant" if last == "u" else "user"

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for last, (cost, audit, kept) in list(out.items()):
                role = following(last)
                offer(out, role[0], (cost + 2, audit + "I", [*kept, (role, "")]))
        return out

    for role, text, gone, cut in turns:
        after = {}
        for last, (cost, audit, kept) in inserted(states).items():
            offer(after, last, (cost + 3, audit + "D", kept))
            if gone:
                continue
            new = following(last)
            offer(after, new[0], (cost + 2 + cut, audit + "R", [*kept, (new, text)]))
            if role[:1] == new[0] or (role[:1] == "s" and last == ""):
                offer(after, role[:1], (cost + cut, audit + "K", [*kept, (role, text)]))
        states = after
    return min((v for k, v in inserted(states).items() if k in ("", "a")), key=lambda v: v[:2])


def brute(data):
    out = []
    for conv in {d[0] for d in data}:
        turns = sorted((d for d in damage(data) if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0, d[2].encode(), d[3].encode()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, _, role, text in turns:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            again, blank = (role, text) in seen, not body
            cut = not blank and not again and body[-1] not in ".!?"
            seen.add((role, text))
            counts = [counts[0] + blank, counts[1] + (again and not blank), counts[2] + cut]
            marked.append((role, text, blank or again, cut))
        numbers = [t[1] for t in turns if t[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, kept = best_edits(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r[c] for c in NAMES) for r in rows(turn_repair.repaired_after_damage(frame))), key=str)


def talks(rng, n, longest, first=0):
    data = []
    for conv in range(first, first + n):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "ufo", None])
            text = rng.choice(["Yes.", "No", "Why?", " \t", "", None, "a\nb!", "Ende \x0b", "é…", f"only {rng.random()}."])
            data.append((conv, rng.choice([turn, turn, turn, turn * 3, None, 5]), role, text))
    return data


def test_against_brute_force(spark, rng_seed=4):
    data = talks(random.Random(rng_seed), 300, 14)
    data += [(400, 0, "user", "x.")] + [(t, t, "user", "one.") for t in range(1000, 1040)]
    assert found(spark.createDataFrame(data, KIND).repartition(4)) == brute(data)


@pytest.mark.parametrize(("most_rows", "most_chars"), [(1, 1 << 20), (3, 1 << 20), (7, 30), (64, 1 << 20)])
def test_conversations_longer_than_a_block(spark, monkeypatch, most_rows, most_chars):
    """Long ones go block by block over all tasks, with the same results."""
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", most_rows)
    monkeypatch.setattr(turn_repair, "BLOCK_CHARS", most_chars)
    rng = random.Random(most_rows)
    data = talks(rng, 25, 12) + talks(rng, 2, 300, first=100) + [(200, 7, "user", "same.")] * 90 + [(200, t, "assistant", "OK") for t in range(60)]
    data += [(None, t, "user", "one.") for t in range(20)]
    assert found(spark.createDataFrame(data, KIND).repartition(3)) == brute(data)


def test_edits_make_the_repaired_conversation(spark, monkeypatch):
    data = damage(talks(random.Random(8), 30, 12) + talks(random.Random(9), 1, 90, first=50))
    frame = spark.createDataFrame(data, KIND).repartition(3)
    for most_rows in (4096, 16):
        monkeypatch.setattr(turn_repair, "BLOCK_ROWS", most_rows)
        whole = {r["conv_id"]: r for r in rows(turn_repair.repaired(frame))}
        order = lambda r: (str(r["conv_id"]), r["part"], r["block"], r["nth"])
        for conv, made in itertools.groupby(sorted(rows(turn_repair.edited_turns(frame)), key=order), key=lambda r: r["conv_id"]):
            made = list(made)
            assert "".join(r["edit"] for r in made) == whole[conv]["audit"]
            kept = [(r["role"], r["text"]) for r in made if r["role"] is not None]
            assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
            assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest() == whole[conv]["repaired_sha256"]


def test_search_from_both_ends_equals_search_from_one():
    """Every entry and every rest behind the last row, against the one-sided distances."""
    rng = random.Random(6)
    for _ in range(400):
        steps = [(rng.choice("suat"), rng.random() < 0.3, rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randrange(1, 9))]
        behind = [rng.choice([0, 1, 2, 5, FAR]) for _ in range(4)]
        if min(behind) == FAR:
            continue
        lattice = Lattice(steps, tail=False)
        for entry in range(4):
            direct = min(a + b for a, b in zip(lattice.distances(entry), behind, strict=True))
            if direct < FAR:
                cost, path = lattice.cheapest(entry, behind)
                assert cost == direct and path[-1][1] // 4 == len(steps)
    assert Lattice([], tail=True).cheapest(NONE, END) == (0, [])


def test_time_grows_with_length():
    took = []
    for n in (2_000, 8_000):
        start = time.perf_counter()
        cost, path = Lattice([("u", False, 0)] * n, tail=True).cheapest(NONE, END)
        took.append(time.perf_counter() - start)
        assert cost == n and [letter for letter, _ in path] == ["K", "R"] * (n // 2)
    assert took[1] < 8 * took[0] + 0.5


def test_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns, no rows."""
    data = [
        (None, None, None, None), (None, None, None, None), (1, None, "user", "a."), (1, None, "assistant", None), (2, 3, None, "x"),
        (3, 0, "user", "y" * 200_000), (3, 1, "assistant", " " * 50_000 + "."), (4, -5, "system", "s."), (4, 10**12, "user", ""),
        (5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b."), (6, 1, "user", "q?"), (6, 1, "user", "q?"), (6, 1, "assistant", "r"),
    ]
    frame = spark.createDataFrame(data, KIND)
    for name in ("audit", "kind", "c", "copy", "part", "a.b"):
        frame = frame.selectExpr("*", f"'mine' as `{name}`")
    wanted = [tuple(min(v, 2**63 - 1) if isinstance(v, int) else v for v in row) for row in brute(data)]
    assert found(frame) == sorted(wanted, key=str)
    assert found(frame.limit(0)) == []

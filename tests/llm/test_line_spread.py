from pyspark.sql import functions as F

from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401
from tallyward.llm import line_spread


def brute(docs, sites):
    """Widespread lines go everywhere but from the smallest document that has them, and its exact copies."""

    def trimmed(text):
        return [line.strip(" \t\r\f\v") for line in (text or "").split("\n")]

    def sequence(text):
        return tuple(line for line in trimmed(text) if line)

    spread, first = {}, {}
    for doc, text, _, source, _ in docs:
        for line in sequence(text):
            spread.setdefault(line, set()).add(source)
            if doc is not None and (line not in first or doc < first[line][0]):
                first[line] = (doc, sequence(text))
    wide = {line for line, on in spread.items() if len(on) >= sites}
    out = []
    for doc, text, _, _, _ in docs:
        lines, seen, gone = (text or "").split("\n"), set(), []
        for n, line in enumerate(trimmed(text)):
            if line in wide:
                if line in first and first[line][1] == sequence(text) and line not in seen:
                    seen.add(line)
                else:
                    gone.append(n)
        out.append((doc, "\n".join(line for n, line in enumerate(lines) if n not in gone) if gone else text, len(gone)))
    return out


def test_against_brute_force(frame, rng):
    common = [prose(rng, 6) for _ in range(12)]  # on 1, 3, 5 ... sites
    docs = []
    for n in range(260):
        own = [prose(rng, 12) + str(n * 31 + k) for k in range(4)]
        source = n % 24
        for k, line in enumerate(common):
            if source <= 2 * k and rng.random() < 0.5:
                own.insert(rng.randrange(len(own)), rng.choice(["", "  ", "\t"]) + line)
        docs.append(document(n, "\n".join(own), f"s{source}"))
    docs += [document(900 + n, common[11] + "\n" + common[10] + "\nend", f"s{n}") for n in range(20)]
    docs += [document(1000 + n, "copied line\n\nanother copied line\n copied line", f"s{n}") for n in range(20)]  # all of it widespread
    docs += [document(1100 + n, common[11] + "\nown " + str(n), f"s{n}") for n in range(20)]  # most of it widespread
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in rows(line_spread.without_spread_lines(frame(docs, 6)))}
    assert got == set(brute(docs, line_spread.SITES))
    assert sum(r[2] for r in got) > 100


def test_near_threshold_is_exact(frame):
    docs = [document(n, f"shared line here\nown {n} words of it that are many more than the other ones", f"s{n}") for n in range(8)]
    assert sum(r["n_removed"] for r in rows(line_spread.without_spread_lines(frame(docs)))) == 7
    assert sum(r["n_removed"] for r in rows(line_spread.without_spread_lines(frame(docs[:7])))) == 0


def test_odd_rows(frame, odd_rows):
    source = frame(odd_rows).withColumn("removed", F.lit("x")).withColumn("n_lines", F.lit("y")).withColumn("h1", F.lit("z"))
    got = line_spread.without_spread_lines(source)
    assert set(got.columns) == {*source.columns, "n_removed"}
    found = rows(got)
    assert len(found) == len(odd_rows) and {r["doc_id"] for r in found if r["text"] is None} == {None, 1}
    assert line_spread.without_spread_lines(frame([])).count() == 0

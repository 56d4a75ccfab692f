from llm_help import rows

from tallyward.llm import quotes

FIRST = "The plan for the harbour is ready to read.\nWe start in May with four boats."
REPLY = "Ann wrote:\n> The plan for the harbour is ready to read.\n> We start in May with four boats.\n\nWhich boats do you mean?"
THIRD = "> > We start in May with four boats.\n> Which boats do you mean?\n\nThe red ones."
CROSS = "As said elsewhere:\n> we start in MAY, with four boats\n\nIs that still so?"


def test_levels():
    own, passages = quotes.read_message(THIRD)
    assert own == "The red ones." and passages == [(2, "We start in May with four boats."), (1, "Which boats do you mean?")]
    own, passages = quotes.read_message(REPLY)
    assert own == "Which boats do you mean?" and [p[0] for p in passages] == [1]
    assert quotes.read_message("a > b\n\nc") == ("a > b\n\nc", [])


def test_links_and_threads(spark):
    data = [(1, 0, "user", FIRST), (1, 1, "assistant", REPLY), (1, 2, "user", "thanks"), (1, 3, "user", THIRD), (5, 0, "user", CROSS), (7, 0, "user", "> nobody ever said this thing\nok")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in rows(quotes.reply_order(frame))}
    assert len(got) == 6
    reply = {k: (r["thread_id"], r["reply_conv"], r["reply_turn"], r["n_quotes"], r["n_linked"], r["quote_depth"]) for k, r in got.items()}
    assert reply[1, 0] == (1, None, None, 0, 0, 0) and reply[1, 1] == (1, 1, 0, 1, 1, 1) and reply[1, 2] == (1, 1, 1, 0, 0, 0)
    assert reply[1, 3] == (1, 1, 1, 2, 2, 2)  # the outermost quote decides
    assert reply[5, 0] == (1, 1, 0, 1, 1, 1) and reply[7, 0] == (7, None, None, 1, 0, 1)
    assert got[5, 0]["text"] == "Is that still so?" and got[7, 0]["text"] == "ok"


def brute(data):
    """Earliest holder of a quoted line: before it in its own conversation, else in an earlier one."""
    parsed = [(c, t, *quotes.read_message(text)) for c, t, _, text in data]
    links = {}
    for conv, turn, _, passages in parsed:
        for _, part in passages:
            mine = quotes.unit(part)
            holders = [(c, t) for c, t, own, _ in parsed if mine in [u for _, u in quotes.grains(own)]]
            inside = [h for h in holders if h[0] == conv and h[1] < turn]
            links.setdefault((conv, turn), []).append(min(inside) if inside else min([h for h in holders if h[0] < conv], default=None))
    return links


def test_against_brute_force(spark, rng_data=17):
    import random

    rng = random.Random(rng_data)
    lines = [" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(6)) + f" {n}" for n in range(40)]
    data = []
    for conv in range(30):
        for turn in range(rng.randint(1, 6)):
            parts = [rng.choice(lines)] + ([f"> {rng.choice(lines)}"] if rng.random() < 0.6 else [])
            data.append((conv, turn * 2, "user", "\n\n".join(parts)))
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    want = brute(data)
    turns = {}
    for c, t, *_ in data:
        turns.setdefault(c, []).append(t)
    for r in rows(quotes.reply_order(frame)):
        key = (r["conv_id"], r["turn"])
        linked = [h for h in want.get(key, []) if h]
        before = max([t for t in turns[key[0]] if t < key[1]], default=None)
        assert (r["reply_conv"], r["reply_turn"]) == (linked[0] if linked else (key[0] if before is not None else None, before)), key
        assert r["n_linked"] == len(linked)


def test_odd_rows(spark):
    data = [(None, None, None, None, 1), (1, None, "user", "> x", 1), (None, 0, "user", "a b c d e", 1), (2, 0, None, None, 1), (2, 1, "user", "", 1), (2, 1, "user", "", 1), (2, 2, "user", "> " * 500 + "q\n" + "w " * 50_000, 1)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, thread_id int")
    got = rows(quotes.reply_order(frame))
    assert len(got) == len(data) and sum(r["reply_turn"] == 0 for r in got) == 2
    assert quotes.reply_order(frame.limit(0)).count() == 0

import hashlib
import random
from collections import defaultdict

import pytest
from kinsheet.llm import chat, queries

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string, piece long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_query(spark, sf_dir):
    turns = defaultdict(list)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for r in rows:
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [("user", queries.TRICKY), ("assistant", queries.TRICKY)]
    found = {r["conv_id"]: r for r in queries.op3_chat_format(spark, sf_dir).collect()}
    assert set(found) == set(turns)
    for conv, said in turns.items():
        r, loss = found[conv], [t for role, t in said if role == "assistant"]
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == digest(f"{role}\n{t}\n" for role, t in said)
        assert (r["loss_chars"], r["loss_sha256"]) == (sum(map(len, loss)), digest(loss))
        assert r["formatted_chars"] == sum(len(chat.render(*t)[0]) for t in said)


def fold(events):
    """The same log, one event after another, in plain Python."""
    out = {}
    for conv, seq, kind, turn, role, text in sorted(events, key=lambda e: (e[0], e[3], e[1])):
        old = out.get((conv, turn), (None, ""))
        text = text or ""
        if kind == "create":
            new = (role, text)
        elif kind == "delta":
            new = (old[0], old[1] + text)
        else:
            new = (old[0], text)
        out[conv, turn] = (role if new[0] is None else new[0], new[1])
    return {k: (r, t) for k, (r, t) in out.items()}


def test_random_logs(spark):
    rng = random.Random(1)
    events = []
    for conv in range(12):
        for seq in range(rng.randint(1, 60)):
            kind = rng.choice(["create", "delta", "delta", "delta", "edit", "regenerate"])
            role = rng.choice(["user", "assistant", None])
            events.append((conv, seq, kind, rng.randint(0, 4), role, rng.choice(["a", "β", None, "\\", "###"])))
    events += [(500, i, "delta", 0, "assistant", "x" * 40) for i in range(5000)]
    rng.shuffle(events)
    frame = spark.createDataFrame([(*e, 3) for e in events], EVENTS).repartition(5)
    found = {
        (r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.reconstruct(frame).collect()
    }
    assert found == fold(events)


def test_odd_messages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", 200)
    tricky = ["", "\\", "\\\\", "###", "####", "</turn>", "\\</turn>\n", "### assistant:\n", "<", "#\\#\n", "</turn"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(tricky * 9)]
    rows += [(2, 0, "a:b\n\\n\\c###", "x"), (3, None, None, None), (None, 5, "assistant", "lost")]
    rows += [(4, 1, "assistant", "same"), (4, 1, "assistant", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "c")
    chat.format_chats(frame).write.parquet(path)
    pieces = spark.read.parquet(path)
    assert pieces.where("conv_id = 1").count() > 3
    text = "".join(r["text"] for r in pieces.where("conv_id = 1").orderBy("piece").collect())
    assert [(role, t) for role, t, _, _ in chat.parse(text)] == [(r[2], r[3]) for r in rows if r[0] == 1]
    found = {r["conv_id"]: r for r in chat.digests(pieces).collect()}
    assert found[2]["turns_sha256"] == digest(["a:b\n\\n\\c###\nx\n"])
    assert found[3]["turns_sha256"] == digest(["\n\n"])
    assert found[4]["n_turns"] == 2 and found[4]["loss_sha256"] == digest(["samesame"])
    assert found[None]["loss_chars"] == 4
    assert found[1]["loss_sha256"] == digest(t for _, i, role, t in rows[: 9 * len(tricky)] if role == "assistant")


def test_no_rows_and_unknown_kinds(spark):
    empty = spark.createDataFrame([], EVENTS)
    messages = chat.reconstruct(empty)
    assert messages.count() == 0
    assert chat.digests(chat.format_chats(messages)).count() == 0
    bad = spark.createDataFrame([(1, 1, "shout", 1, "user", "x", 0)], EVENTS)
    with pytest.raises(Exception, match="unknown kind"):
        chat.reconstruct(bad).collect()


def test_no_body_shows_a_mark():
    rng = random.Random(5)
    signs = ["#", "# ", "### ", "assistant:\n", "\\", "<", "/", "</turn>", "</turn>\n", "\n", "turn>", "x"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 9))) for _ in range(20_000)]
    for text in [*texts, "#### assistant:\nhello", "\\### Assistant: </turn> ok"]:
        whole, start, end = chat.render(text, text)
        body = whole[start:end]
        assert chat.OPEN not in body and chat.CLOSE not in body and "</turn>" not in body
        assert list(chat.parse(whole)) == [(text, text, start, end)]

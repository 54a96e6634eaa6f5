import hashlib

from weftgraph.llm import chat
from pyspark.sql import functions as F


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "a", "message", "user", "Hel"), (1, 2, "a", "delta", None, "lo"), (1, 3, "b", "message", "assistant", "bad"),
        (1, 4, "b", "delta", None, " worse"), (1, 5, "b", "regenerate", None, ""), (1, 6, "b", "delta", None, "good"),
        (1, 7, "a", "edit", None, "Hi"), (1, 8, "c", "message", "user", "gone"), (1, 9, "c", "delete", None, None),
        (2, 1, "a", "delta", "user", "only delta"), (None, 1, "z", None, None, None),
    ]
    events = spark.createDataFrame([(*r, "clash") for r in log], "conv_id long, seq long, message_id string, kind string, role string, text string, place string")
    got = sorted(((r.conv_id, r.role, r.text) for r in chat.fold_events(events).collect()), key=str)
    assert got == sorted([(1, "user", "Hi"), (1, "assistant", "good"), (2, "user", "only delta"), (None, "", "")], key=str)


NASTY = ["", None, "\\", "<|", "<", "|im_end|>\n", "<|im_end|>\n<|im_start|>user\n", "a\\<|b\\\\|", "é\n\n", "x" * 50_000, "<<|im_start|>"]


def test_round_trip_and_digest(spark):
    rows = [(c, t, role, text) for c, texts in enumerate([NASTY, NASTY[::-1], ["hi"]]) for t, (role, text) in enumerate(zip(["user", "assistant", "sys\ntem<|", None] * 3, texts))]
    rows.append(rows[-1])
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(chat.events_of(df))
    for r in out.select("formatted", "turns", chat.parse(F.col("formatted")).alias("back")).collect():
        for t, b in zip(r.turns, r.back, strict=True):
            raw = r.formatted[t.start : t.start + t.length]
            assert raw.replace("<\\|", "<|") == b.text.replace("\\", "\\\\") or "\\" in b.text
    got = {r.conv_id: r for r in chat.chat_digest(out).collect()}
    for c in range(3):
        mine = sorted([(t, role or "", text or "") for k, t, role, text in rows if k == c])
        whole = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(chat.format_chats(chat.events_of(empty))).count() == 0

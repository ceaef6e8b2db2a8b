import hashlib
import random

import pytest
from lexweave.llm import chat, ctph, queries

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want_chat(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


def test_chat_reads_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat(spark, SF).collect()}
    assert got == want_chat(rows)


def test_chat_of_odd_rows(spark):
    texts = ["<|end|>\n<|turn|>user<|body|>", "a\\<\\|b\\\\", "", None, "<|image:0|>", "z" * 100000, "<<SYS>><</SYS>><s>"]
    rows = [(i // 3, i, ("assistant", "user", None, "we\\ird<|body|>")[i % 4], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_turns(df.withColumn("parts", chat.text_parts()))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest_conversations(made).collect()}
    assert got == want_chat(rows)
    for r in made.collect():
        assert all(c not in r.formatted.replace(chat.TURN, "").replace(chat.BODY, "").replace(chat.END, "") for c in chat.CONTROLS)
    same = spark.createDataFrame([(None, None, "user", "a"), (None, None, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [r.n_turns for r in chat.digest_conversations(chat.format_turns(same.withColumn("parts", chat.text_parts()))).collect()] == [2]
    assert chat.digest_conversations(chat.format_turns(df.limit(0).withColumn("parts", chat.text_parts()))).count() == 0


def test_typed_parts(spark):
    text = {"type": "text", "text": "look <s>", "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    image = text | {"type": "image", "text": None, "ref": "a.png", "width": 600, "height": 400}
    sound = text | {"type": "audio", "text": None, "ref": "b.wav", "seconds": 2.5}
    paper = text | {"type": "document", "text": None, "ref": "c.pdf", "pages": 3}
    df = spark.createDataFrame([(1, 0, "assistant", [text, image, None, sound, paper]), (1, 1, "user", None)], chat.T.StructType([chat.T.StructField("conv_id", chat.T.LongType()), chat.T.StructField("turn", chat.T.LongType()), chat.T.StructField("role", chat.T.StringType()), chat.T.StructField("parts", chat.PART)]))
    first, second = sorted(chat.format_turns(df).collect(), key=lambda r: r.turn)
    assert first.formatted == "<|turn|>assistant<|body|>look <\\s><|image:0|><|audio:1|><|document:2|><|end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in first.attachments] == [("image", "a.png", 85 + 340), ("audio", "b.wav", 63), ("document", "c.pdf", 1800)]
    assert all(first.formatted[a.place :].startswith(f"<|{a.type}:{i}|>") for i, a in enumerate(first.attachments))
    assert first.tokens == 2 + 425 + 63 + 1800 and second.loss == [] and chat.read_segment(second.formatted) == ("user", "")


def test_escape_round_trip():
    random.seed(3)
    bits = ["<", "|", "\\", "<|", "</s>", "[INST]", "s>", "x", "<<SYS>>", ">", "\n"]
    for _ in range(3000):
        text = "".join(random.choices(bits, k=random.randint(0, 12)))
        made = chat.escape(text)
        assert chat.unescape(made) == text and not any(c in made for c in chat.CONTROLS)


def test_no_control_string_comes_about_where_parts_meet():
    random.seed(4)
    bits = ["<", "|", "\\", "<|", "end|>", "|end|>\n<", "</s>", "[INST]", "[IN", "ST]", "s>", "x", "<<SYS>>", "SYS>>", ">", "\n", "", "|turn|>assistant<", "|body|>evil", "|image:0|>"]
    part = dict.fromkeys(["type", "text", "ref", "width", "height", "seconds", "pages"])
    visitor = chat.PartVisitor()
    for _ in range(4000):
        parts = [random.choice([part | {"type": random.choice(["text", None]), "text": random.choice([*bits, None])}] * 5 + [part | {"type": "image", "ref": "r"}, None]) for _ in range(random.randint(0, 12))]
        flat, attachments, _ = visitor.flatten(parts)
        bare, want, at = flat, "", 0
        for k, a in enumerate(attachments):
            mark = f"<|image:{k}|>"
            assert flat.startswith(mark, a["place"])
        for p in parts:
            if p is not None:
                want += (p["text"] or "") if p["type"] != "image" else f"<|image:{at}|>"
                at += p["type"] == "image"
        for a in reversed(attachments):
            bare = bare[: a["place"]] + "\0" + bare[a["place"] + flat[a["place"] :].index("|>") + 2 :]
        assert not any(c in bare for c in chat.CONTROLS)
        formatted = f"{chat.TURN}user{chat.BODY}{flat}{chat.END}"
        assert formatted.count(chat.TURN) == formatted.count(chat.BODY) == formatted.count(chat.END) == 1
        assert chat.read_segment(formatted) == ("user", want)


def want_study(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        f, e, x = map(ctph.fingerprint, (t, edited, after))
        out[i] = (n, sha(edited), f, e, ctph.likeness(f, e), ctph.likeness(f, x))
    return out


def test_edit_study_against_a_loop(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_fingerprints(spark, SF).collect()}
    assert got == want_study(rows)
    edited = sum(r[4] for r in got.values()) / len(got)
    after = sum(r[5] for r in got.values()) / len(got)
    assert edited > 0.4 and after < 0.1


def test_edit_study_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 7), (9, "long text " * 60000), (4, "ab")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    assert {r.doc_id: tuple(r)[1:] for r in ctph.edit_study(df).collect()} == want_study(rows)
    lone = spark.createDataFrame([(5, "abc def")], "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in ctph.edit_study(lone).collect()} == want_study([(5, "abc def")])
    assert ctph.edit_study(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "a"), (5, "b"), (None, "c"), (5, "a")], "doc_id long, text string")
    assert ctph.edit_study(twice).count() == 4


def slow_marks(data, size):
    """Piece ends by the definition, a byte at a time."""
    out = []
    for t in range(len(data)):
        roll = 0
        for j in range(ctph.WINDOW):
            at = t - ctph.WINDOW + 1 + j
            roll += (data[at] if at >= 0 else 0) * int(ctph._FACTORS[j])
        roll %= 1 << 32
        roll ^= roll >> 15
        roll = (roll * 0x2C1B3C6D % (1 << 32) >> 2) + 1
        if roll % size == 0:
            out.append(t + 1)
    return out


def test_marks_and_blocks(monkeypatch):
    random.seed(5)
    data = random.randbytes(3000)
    assert ctph.marks(data, 12)[0].tolist()[:-1] == slow_marks(data, 12)
    whole = ctph.fingerprint(data.decode("latin-1"))
    ctph.powers.cache_clear()
    monkeypatch.setattr(ctph, "BLOCK", 256)
    assert ctph.fingerprint(data.decode("latin-1")) == whole
    ctph.powers.cache_clear()


@pytest.mark.parametrize("size", [40, 400, 4000, 40000])
def test_likeness_follows_the_edit(size):
    random.seed(size)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    text, other = (" ".join(word() for _ in range(size // 6)) for _ in range(2))
    f = ctph.fingerprint(text)
    near = ctph.likeness(f, ctph.fingerprint(text[: len(text) - 20] + other[:20]))
    far = ctph.likeness(f, ctph.fingerprint(other))
    assert near > 0.4 and far < 0.1 and near > far and ctph.likeness(f, f) == 1.0
    assert len(f.split(":")[1]) <= 64 and len(f.split(":")[2]) <= 32

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lexweave.llm import align, pieces, queries, repair

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, pairs string, ids string"
LONG = "née  " * 2000 + "z" * 6000 + " " * 300 + "naïve. " * 500
ODD = [(3, "a b", "x", "y"), (3, "a b", "x", "y"), (None, LONG, "x", None), (1, None, None, None), (2, "", "y", "y"), (4, " ", "y", "y"), (5, "a▁b  <s></s><|endoftext|><0x41>\n\t中文 🙂!\0", "y", "y"), (6, "end <|endoftext|> of　it é", "", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair

ROLE = {"u": "user", "a": "assistant", "s": "system"}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_force(rows):
    """Tries every string of edits up to the cost of deleting all rows; returns cost, edits, repaired rows."""
    faults, best = faults_of(rows), (2 * len(rows), "D" * len(rows), [])
    allowed = re.compile("(s?(ua)+)?")

    def go(i, cost, edits, out):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            if allowed.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = min(best, (cost, edits, out))
        else:
            (role, text), more = rows[i], 5 * (faults[i] == "truncated")
            go(i + 1, cost + 2, edits + "D", out)
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, cost + more, edits + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + more + 1, edits + "R", [*out, (new, text)])
        for new in ("user", "assistant"):
            go(i, cost + 5, edits + "I", [*out, (new, "")])

    go(0, 0, "", [])
    return best


def summary(conv_id, turns, rows):
    faults, (cost, edits, out) = faults_of(rows), brute_force(rows)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha("\n".join(f"{r}:{t}" for r, t in out)))


def test_repair_against_every_string_of_edits(spark):
    random.seed(11)
    given, want = [], []
    for c in range(250):
        n = random.randint(1, 5)
        turns = sorted(random.sample(range(9), n))
        if c % 7 == 0:
            turns[0] = None
        rows = [(random.choice(["user", "assistant", "system", "tool", "", "u", "user"]), random.choice(["a.", "b.", "c?", "cut", "", " \n"])) for _ in turns]
        given += [(c, t, r, x, "clash") for t, (r, x) in zip(turns, rows, strict=True)]
        want.append(summary(c, turns, rows))
    random.shuffle(given)
    df = spark.createDataFrame(given, "conv_id long, turn int, role string, text string, kind string")
    assert sorted(map(tuple, repair.repair_summary(df).collect())) == want
    rows, edits = defaultdict(list), defaultdict(str)
    for r in sorted(repair.repair_rows(df).collect(), key=lambda r: (r.conv_id, r.place)):
        edits[r.conv_id] += r.edit
        rows[r.conv_id] += [f"{r.role}:{r.text}"] * (r.edit != "D")
    assert [(c, edits[c], sha("\n".join(rows[c]))) for c in range(250)] == [(w[0], w[7], w[8]) for w in want]


def test_repair_of_odd_rows(spark):
    long = "x" * 50_000 + ". "
    given = [(None, 0, "user", long), (None, 1, "assistant", "b."), (1, 3, "user", "a."), (1, 3, "user", "a."), (1, 4, "assistant", "b."), (2, None, None, None)]
    df = spark.createDataFrame(given, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_summary(df, spark.createDataFrame([(7,), (1,)], "conv_id long")).collect()}
    assert got == {
        None: (0, 0, 0, 0, 0, 0, "KK", sha(f"user:{long}\nassistant:b.")),
        1: (0, 0, 1, 0, 1, 2, "KDK", sha("user:a.\nassistant:b.")),
        2: (0, 1, 0, 0, 0, 2, "D", sha("")),
        7: (0, 0, 0, 0, 0, 0, "", sha("")),
    }
    assert repair.repair_summary(df.limit(0)).count() == repair.repair_rows(df.limit(0)).count() == 0


def test_edits_of_a_long_conversation():
    random.seed(2)
    codes = bytearray(repair.code_of(random.choice("sua"), random.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(20_000))
    cost, edits = repair.cheapest(codes)
    assert sum(e != "I" for e in edits) == len(codes)
    assert cost >= 2 * edits.count("D") + 5 * edits.count("I") + edits.count("R")


def test_damaged_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    rows = defaultdict(list)
    for r in sorted(table, key=lambda r: (r.conv_id, r.turn)):
        kind, role, text = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, r.role, r.text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows[r.conv_id] += [(r.turn, (role, text))] * {0: 0, 3: 2}.get(kind, 1)
    want = {c: summary(c, [t for t, _ in rows[c]], [x for _, x in rows[c]]) for c in {r.conv_id for r in table}}
    assert {r.conv_id: tuple(r) for r in queries.op11_repair(spark, SF).collect()} == want


# Alignment


def library_tokens(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.token_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.token_file("piece_bpe_32k.model"))
    from lexweave.llm.packing import byte_alphabet

    of = byte_alphabet()
    for text in texts:
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        yield (ids_a, bytes_a, ids_b, bytes_b) if text and b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode() else ([], [], [], [])


def plain_alignments(docs):
    """Byte by byte: which tokens cover it on either side; cuts where both sides' tokens end."""
    every, counts = [], Counter()
    for (doc, _), (ids_a, bytes_a, ids_b, bytes_b) in zip(docs, library_tokens([t or "" for _, t in docs]), strict=True):
        over_a = [i for i, t in enumerate(bytes_a) for _ in t]
        over_b = [i for i, t in enumerate(bytes_b) for _ in t]
        links = list(dict.fromkeys(zip(over_a, over_b, strict=True)))
        groups, seen_a, seen_b = [], 0, 0
        for at in range(len(over_a)):
            if at + 1 == len(over_a) or over_a[at] != over_a[at + 1] and over_b[at] != over_b[at + 1]:
                groups.append(",".join(map(str, ids_a[seen_a : over_a[at] + 1])) + "|" + ",".join(map(str, ids_b[seen_b : over_b[at] + 1])))
                seen_a, seen_b = over_a[at] + 1, over_b[at] + 1
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        counts.update(set(pairs))
        every.append((doc, len(ids_a), len(ids_b), groups, pairs))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return Counter((doc, a, b, len(groups), len(pairs), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), sha(";".join(groups)) if a else "") for doc, a, b, groups, pairs in every)


def weighed(df, **more):
    out = align.weigh_links(df, queries.token_file("byte_bpe_50k.json"), queries.token_file("piece_bpe_32k.model"), **more)
    return Counter(map(tuple, out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))


def test_alignment_against_bytes(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op12_align(spark, SF).collect())) == plain_alignments(docs)


def test_alignment_of_odd_rows(spark, odd):
    want = plain_alignments([r[:2] for r in ODD])
    for head in (0, 5, 1000):  # counts from the join alone, from both ways, from the head alone
        assert weighed(odd, head=head) == want
    assert (5, 0, 0, 0, 0, 0, 0, "") in want and (6, 0, 0, 0, 0, 0, 0, "") not in want
    assert not weighed(odd.limit(0))


def test_groups_and_links_of_cuts():
    group_a, group_b, link_a, link_b = align.link(np.array([2, 3, 7, 9]), np.array([1, 3, 4, 7, 9]))
    assert group_a.tolist() == [0, 0, 1, 2] and group_b.tolist() == [0, 0, 1, 1, 2]
    assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 4)]


# Pieces


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.token_file("piece_bpe_32k.model"))


def same_as_library(texts):
    own, sp = pieces.piece_bpe(queries.token_file("piece_bpe_32k.model")), library()
    ids, ends = own.encode_all(pa.array(texts, pa.string()))
    for text, start, end in zip(texts, [0, *ends], ends, strict=False):
        want = sp.encode(text or "")
        assert ids[start:end].tolist() == want, (text or "")[:100]
        assert own.decode(ids[start:end]).decode() == sp.decode(want), (text or "")[:100]


def test_pieces_against_the_library(spark):
    sp = library()
    want = {r.doc_id: sp.encode(r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_pieces(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_pieces_of_random_text():
    random.seed(5)
    letters = ["a", "e", "t", "th", "ing", "s", "é", "中", "0", "'", " ", "  ", "!", "Ω", "▁", "\n", "<s>", "</s>", "🙂", "\x1c", "﻿", "\0", "ﬁ", "<0x41>", "\t", "한"]
    same_as_library(["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(4000)])
    same_as_library([None, "", " ", "a" * 4000, " " * 3000, "ab" * 3000, "🙂" * 1000, "x" + " " * 65 + "x" * 65])


def test_decoding_of_any_ids():
    random.seed(6)
    own, sp = pieces.piece_bpe(queries.token_file("piece_bpe_32k.model")), library()
    for _ in range(5000):
        ids = [random.choice([0, 1, 2, 264, 259, 300, 28705, *(3 + random.randrange(256) for _ in range(4))]) for _ in range(random.randint(0, 8))]
        assert own.decode(np.array(ids, np.int32)).decode() == sp.decode(ids), ids


def test_pieces_when_none_are_kept(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 10)
    same_as_library(["the cat sat", "on the mat", "the cat", "a" * 70])
    own = pieces.PieceBpe(queries.token_file("piece_bpe_32k.model"))
    own.splits = False  # as where pieces cross markers: texts are their own chunks
    text = "on the  mat, the cat " * 5
    assert own.encode_all(pa.array([text]))[0].tolist() == library().encode(text)


def test_pieces_of_odd_rows(spark, odd):
    model, sp = queries.token_file("piece_bpe_32k.model"), library()
    rows = pieces.decode_ids(pieces.encode_texts(odd, model), model).collect()
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in rows)
    assert got == Counter((d, len(x), tuple(x), sp.decode(x)) for d, t, *_ in ODD for x in [sp.encode(t or "")])
    assert pieces.encode_texts(odd.limit(0), model).count() == 0

import hashlib
import random
import zlib

import pytest

from scriptorium.llm import chat, ogg, queries

DOCS = "doc_id long, text string, media string, n_bytes string"


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 254, 255, 3071, 3072, 3073, 6144, 65025 * 2, 400_000])
def test_ogg_round_trip(size):
    payload = ogg.padded(random.Random(size).randbytes(size))
    assert len(payload) % ogg.UNIT == 0 and payload
    media = ogg.write_ogg(payload)
    found = ogg.read_ogg(media)
    assert found["payload"] == payload and found["streams"] == 2
    streams, _ = ogg.demultiplex(media)
    assert sum(len(p) for packets in streams.values() for p, _ in packets[1:]) == len(payload)
    for packets in streams.values():  # granule positions count the stream's samples
        at = 0
        for p, end in packets[1:]:
            at += len(p)
            assert end == at


def test_ogg_checksum_is_the_format_s():
    slow = 0
    data = b"OggS some bytes"
    for byte in data:
        slow ^= byte << 24
        for _ in range(8):
            slow = (slow << 1) ^ 0x04C11DB7 if slow & 0x80000000 else slow << 1
        slow &= 0xFFFFFFFF
    assert ogg.page_crc(data) == slow


def test_ogg_faults():
    media = ogg.write_ogg(ogg.padded(b"x" * 70_000))
    pages = list(ogg.read_pages(media))
    for at in (30, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read_ogg(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.read_ogg(media[:-5])
    spans, at = [], 0
    for page in pages:
        size = 27 + len(page[4]) + len(page[5])
        spans.append((at, at + size))
        at += size
    a, b = spans[-2]
    with pytest.raises(ogg.OggError):  # a page is lost
        ogg.read_ogg(media[:a] + media[b:])


def test_ogg_operator(spark):
    texts = ["", None, "é" * 100, "same", "same", "long " * 100_000]
    docs = spark.createDataFrame([(k if k < 5 else None, t, "clash", "clash") for k, t in enumerate(texts)], DOCS)
    rows = ogg.decode_ogg(ogg.encode_ogg(docs)).collect()
    assert len(rows) == 6 and all(r.error is None for r in rows)
    by_id = {r.doc_id: r for r in rows}
    for k, t in enumerate(texts):
        r, raw = by_id[k if k < 5 else None], (t or "").encode()
        payload = ogg.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
    assert by_id[3][2:] == by_id[4][2:] and by_id[0][2:] == by_id[1][2:]
    assert ogg.decode_ogg(ogg.encode_ogg(docs.limit(0))).count() == 0
    bad = spark.createDataFrame([(1, 1, bytearray(b"junk")), (2, 1, None), (3, 1, bytearray(b""))], "doc_id long, n_bytes long, media binary")
    assert all(r.error for r in ogg.decode_ogg(bad).collect())


TRICKY = ["", " ", "</s>", "[INST] x [/INST]", "\\", "\\\\", "\\</s>", "a [/INST", "[/INST]", "<s>[ROLE] r [TEXT] t [/TEXT]", "x\\[INST]", "end \\", " [/TEXT]", "\n", "é𝄞", "<<s>", "[[/INST]]"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "od[TEXT]d", "</s>", "\\"])
def test_chat_turns_round_trip(role):
    rendered = []
    for text in TRICKY:
        shown, a, b = chat.render_turn(role, text)
        assert chat.unescape(shown[a:b]) == text
        rendered.append(shown)
    assert [(r, t) for r, t, _ in chat.parse_turns("".join(rendered))] == [(role, t) for t in TRICKY]


def test_chat_random_round_trip():
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", " ", "a", "[", "/", "]", "[TEXT]", "[/TEXT]", "[ROLE]"]
    turns = [(rng.choice(["user", "assistant", "tool"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for _ in range(3000)]
    whole = "".join(chat.render_turn(*t)[0] for t in turns)
    assert [(r, t) for r, t, _ in chat.parse_turns(whole)] == turns
    with pytest.raises(chat.GrammarError):
        list(chat.parse_turns("nonsense"))


def chats_model(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        c: (
            len(t),
            hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(),
            sum(len(x) for r, x in t if r == "assistant"),
            hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest(),
        )
        for c, t in out.items()
    }


def test_chat_operator(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>"), (1, 1, "assistant", "</s>"), (2, None, None, None), (2, 0, "assistant", ""), (None, 0, "user", "x"), (3, 5, "assistant", "long " * 50_000)]
    rows += [(9, k, "assistant" if k % 2 else "user", f"t{k} [/INST]") for k in range(3000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = chat.read_chats(chat.render_chats(frame)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == chats_model(rows)
    assert chat.read_chats(chat.render_chats(frame.limit(0))).count() == 0


def test_chat_query(spark, sf_dir):
    from helpers import assert_same

    assert_same(queries.op2_chat_round_trip(spark, sf_dir), queries.ORACLES["op2_chat_round_trip"], sf_dir)


def test_ogg_query(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op1_ogg_media(spark, sf_dir).collect()}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(documents)
    for r in documents:
        raw = (r.text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        own = rows[r.doc_id]
        assert (own.n_bytes, own.payload_bytes, own.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert own.tail_crc32 == zlib.crc32(payload[-16:])


def test_loss_is_read_under_the_mask():
    """The mask alone says what is loss: a narrower one gives less, whatever the turns say."""
    rendered, start, end = chat.render_turn("assistant", "five words </s> of text")
    user, *_ = chat.render_turn("user", "asks")
    whole, part = chat._Reader(), chat._Reader()
    for reader, mask in ((whole, (start, end)), (part, (start, start + 4))):
        reader.read(user, (0, 0))
        reader.read(rendered, mask)
        reader.row(1)
    assert whole.loss_chars == len("five words </s> of text") and part.loss_chars == 4 and part.n_turns == whole.n_turns == 2
    assert whole.loss.hexdigest() == hashlib.sha256(b"five words </s> of text").hexdigest()

import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd import ODD

from brindle.llm import token_files as f
from brindle.llm.queries import op9_token_files, table, vocabulary_path
from brindle.llm.textbytes import utf8_views

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def blocks():
    rng = np.random.default_rng(1)
    out = [rng.integers(0, 65536, n).astype(np.uint32) for n in (1, 2, 3, 100, f.BLOCK)]
    out += [np.zeros(f.BLOCK, np.uint32), np.full(777, 65535, np.uint32), np.tile(np.arange(5, dtype=np.uint32), 300), (rng.zipf(1.3, f.BLOCK) % 50000).astype(np.uint32)]
    # ids of up to 32 bits
    out += [rng.integers(0, 1 << 32, f.BLOCK).astype(np.uint32), np.array([0, (1 << 32) - 1, 70_000, (1 << 32) - 1], np.uint32)]
    return out


def trip(held, priors):
    coded = f.encode_blocks(held, priors)
    assert all(np.array_equal(a, b) for a, b in zip(held, f.decode_blocks([(len(b), c) for b, c in zip(held, coded)], priors)))
    return coded


def test_blocks_round_trip(monkeypatch):
    held = blocks()
    for priors in ([f.Prior.of(b) for b in held], [f.Prior.of(np.concatenate(held))] * len(held)):
        coded = trip(held, priors)
        # a block's code doesn't depend on its neighbours
        with monkeypatch.context() as m:
            m.setattr(f, "LANES", 2)
            assert f.encode_blocks(held, priors) == coded and f.encode_blocks(held[::-1], priors[::-1]) == coded[::-1]
        sizes = [len(c) for c in coded]
        assert sizes[5] < 100 and sizes[7] < 400 and sizes[4] < 2.05 * f.BLOCK
    assert f.encode_blocks([], []) == [] and f.decode_blocks([], []) == []


def test_files_of_before_stay_readable():
    """The coded words are those that the coder wrote at first with this frame format."""
    held = blocks()
    crcs = [zlib.crc32(b"".join(f.encode_blocks(held, priors))) for priors in ([f.Prior.of(b) for b in held], [f.Prior.of(np.concatenate(held))] * len(held))]
    assert f.MAGIC == b"BTF3" and crcs == [2805759456, 1103094820]


def test_calls_for_each_step():
    """Calls into numpy for each step of the lanes, whose number sets the CPU time of an id (clocks are too rough here): 56 and 61 when both went id by id alike."""
    rng = np.random.default_rng(3)
    held = [(rng.zipf(1.3, f.BLOCK) % 50000).astype(np.uint32) for _ in range(64)]
    priors = [f.Prior.of(np.concatenate(held))] * len(held)

    def calls(run):
        count = 0

        def see(frame, event, arg):
            nonlocal count
            count += event == "c_call"

        sys.setprofile(see)
        try:
            run()
        finally:
            sys.setprofile(None)
        return count / f.BLOCK

    coded = f.encode_blocks(held, priors)
    found = calls(lambda: f.encode_blocks(held, priors)), calls(lambda: f.decode_blocks([(len(b), c) for b, c in zip(held, coded)], priors))
    print("calls a step, coding and decoding:", found)
    assert found[0] < 20 and found[1] < 45


def test_a_usual_task_goes_in_step_at_once():
    """Some 13 frames, as a task of 10 MB of text has them: two parts take twice the steps."""
    order = list(range(13 * f.FRAME // f.BLOCK))
    assert f._parts(order) == [order]


def test_very_many_different_ids():
    """More ids than groups: several share a frequency."""
    rng = np.random.default_rng(2)
    for span, size in ((1 << 18, 300_000), (1 << 32, 200_000)):
        stream = np.concatenate([rng.integers(0, span, size), rng.zipf(1.5, 50_000) % span]).astype(np.uint32)
        prior = f.Prior.of(stream)
        assert prior.bits > 0 and int(prior.width.sum()) == 65536
        held = [stream[k : k + f.BLOCK] for k in range(0, len(stream), f.BLOCK)][-40:]
        trip(held, [prior] * len(held))
        again = f.Prior.unpack(prior.pack())
        assert all(np.array_equal(getattr(prior, c), getattr(again, c)) for c in ("order", "width", "start", "place"))


def test_less_than_general_compressors(spark, library):
    """Fewer bytes than zlib, and than LZMA, of the same blocks; the frame's header counts."""
    import lzma

    texts = [r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    stream = np.concatenate([np.array(e.ids + [2], np.uint32) for e in library.encode_batch(texts, add_special_tokens=False)])
    stream = stream[: f.FRAME]
    prior = f.Prior.of(stream)
    held = [stream[k : k + f.BLOCK] for k in range(0, len(stream), f.BLOCK)]
    coded = trip(held, [prior] * len(held))
    size = sum(map(len, coded)) + len(prior.pack()) + 12 * len(coded)
    narrow = [b.astype("<u2").tobytes() for b in held]
    filters = [{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME}]
    others = [sum(len(zlib.compress(b, 9)) for b in narrow), sum(len(lzma.compress(b, lzma.FORMAT_RAW, filters=filters)) for b in narrow)]
    count = np.bincount(stream)
    share = count[count > 0] / len(stream)
    print("bits an id:", 8 * size / len(stream), "zlib, lzma:", [8 * o / len(stream) for o in others], "order-0 entropy:", -(share * np.log2(share)).sum())
    assert size < 0.9 * min(others)


def test_frames_round_trip_and_damage_is_seen():
    data = [(3, 9, b"abcd"), (2, 8, b"xy")]
    prior = f.Prior.of(np.array([4, 4, 9, 1 << 31], np.uint32))
    frame = f.pack_frame(np.array([5, -1]), np.array([3, 2]), prior, data)
    ids, sizes, again, cut = f.unpack_frame(frame)
    assert ids.tolist() == [5, -1] and sizes.tolist() == [3, 2] and cut == data and again.order.tolist() == [4, 9, 1 << 31]
    with pytest.raises(ValueError):
        f.unpack_frame(b"XXXX" + frame[4:])
    for k in range(4, len(frame) - 6):
        with pytest.raises(ValueError):
            f.unpack_frame(frame[:k] + bytes([frame[k] ^ 1]) + frame[k + 1 :])


def test_pieces_equal_the_library(library, monkeypatch):
    texts = [t or "" for t in ODD] + ["<|endoftext|> a", "a  b\n\n c\t\td ", "it's WE'RE 'll x²½ µ ª", " leading", "trailing  ", "'s", " 's", "''s 'sand they'rest x'l y'll'd 'm9 !'s \n's"]
    rng = random.Random(8)
    texts += ["".join(rng.choice(["a", "Bé", " ", "  ", "\n", "\t", "'", "'s", "'re", "1", "½", "!", "÷", "×", "ll", "<|", "ÿµ"]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["word " * 300_000]
    raw, at = utf8_views(pa.array(texts))
    encoder = f.PieceIds(PATH)
    for limit in (10**6, 3):
        monkeypatch.setattr(f, "CACHE_PIECES", limit)
        for t, ids in zip(texts, encoder.encode(raw, at)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t[:200]
    assert f._narrow([70000]).tolist() == [70000]
    encoder.splits = False
    assert [x.tolist() for x in encoder.encode(raw, at)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(r):
    return r[1]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, op9_token_files(spark, sf).collect()), key=key) == expected(rows, library)


def test_odd_tables_and_small_frames(spark, documents, library, tmp_path, monkeypatch):
    monkeypatch.setattr(f, "FRAME", 40)
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "same id"), (3, "same id"), (-7, "negative"), (50, "long " * 9000)]
    f.write_tokens(documents(rows, start=1, ids=2).repartition(3), PATH, str(tmp_path / "a"), 2)
    got = f.read_tokens(spark, str(tmp_path / "a"), ids=True).collect()
    assert sorted([tuple(r)[:4] for r in got], key=key) == expected(rows, library)
    assert next(r["ids"] for r in got if r["doc_id"] == -7) == library.encode("negative", add_special_tokens=False).ids + [2]
    f.write_tokens(documents([]), PATH, str(tmp_path / "b"), 2)
    assert f.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_damaged_block_is_reported(spark, documents, tmp_path):
    f.write_tokens(documents(["some words to damage"]), PATH, str(tmp_path / "a"), 2)
    row = spark.read.parquet(str(tmp_path / "a")).first()
    frame = bytes(row["frame"])
    bad = frame[:-9] + bytes([frame[-9] ^ 0x55]) + frame[-8:]
    spark.createDataFrame([(row["part"], row["seq"], row["before"], row["n_docs"], row["n_tokens"], bytearray(bad))], "part int, seq long, before long, n_docs long, n_tokens long, frame binary").write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="damaged block"):
        f.read_tokens(spark, str(tmp_path / "b")).collect()

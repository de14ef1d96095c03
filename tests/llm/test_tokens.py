import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statementspark.llm import packing, token_files, tokens

from ..conftest import SF

ODD = ["", "a  b\n\n c  d 　 x", "  lead", "trail \n", "x\ty z\r\nq", "é è \n ñ", "<|endoftext|> a", "I'm we're 's", "a  b", None, "ΑΣ ΑΣΑ", "a,́b é-x ×- a—b, c", "ab12-3c\nD'e", "x" * 200 + " y", "a" * 70, "İI ǅ ©® ½"]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("memo", [2_000_000, 5])
@pytest.mark.parametrize("chunk", [1 << 21, 8])
def test_units_give_the_ids_of_whole_texts(name, memo, chunk, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    coder = tokens.Encoder(public_tokenizers.path(name), memo)
    ids, starts = coder.encode(pa.array(ODD))
    whole = [x.ids for x in coder.tokenizer.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == whole


PIECES = ["foo", "bar", "\x00", "\x00\x00", " ", "\n", "<|endoftext|>", "<|startoftext|>", "é", "\u3000", "😀", "x" * 70, "'s", "-", "12", "\u0301", "İ", "\u212a", "\ufeff"]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("memo", [1_000_000, 50])
def test_random_texts_with_zeros_and_special_strings_in_any_order(name, memo):
    rng = np.random.default_rng(memo)
    texts = ["".join(rng.choice(PIECES, rng.integers(0, 9))) for _ in range(10_000)] + ["foo bar", "foo\x00 bar", "foo \x00bar", "\x00", ""]
    coder = tokens.Encoder(public_tokenizers.path(name), memo)
    whole = {t: x.ids for t, x in zip(texts, coder.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)}
    for _ in range(2):
        rng.shuffle(texts)
        at = 0
        while at < len(texts):
            part = texts[at : at + int(rng.integers(1, 3000))]
            ids, starts = coder.encode(pa.array(part))
            assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [whole[t] for t in part]
            at += len(part)


def test_equal_hashes_of_different_units_are_told_apart(monkeypatch):
    """With a first hash that takes all units for one, the second hash and the length decide."""
    plain = tokens.Encoder._hashes
    monkeypatch.setattr(tokens.Encoder, "_hashes", lambda self, data, cuts, ends, kind: plain(self, data, cuts, ends, 1) if kind else np.ones(len(cuts), np.uint64))
    coder = tokens.Encoder(public_tokenizers.path(FILES[0]))
    ids, starts = coder.encode(pa.array(ODD))
    whole = [x.ids for x in coder.tokenizer.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == whole


def test_units_that_come_again_are_learned_once(monkeypatch):
    asked = []
    plain = tokens.Encoder._fresh
    monkeypatch.setattr(tokens.Encoder, "_fresh", lambda self, units: asked.extend(units) or plain(self, units))
    coder = tokens.Encoder(public_tokenizers.path(FILES[0]), 300)
    common = " ".join(f"common{k}" for k in range(50))
    for n in range(30):
        text = f"start {common} " + " ".join(f"rare{n}x{k}" for k in range(60))
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.known <= 300 and sum("common" in x for x in asked) == 50


def test_places_among_running_sums_by_brute_force():
    rng = np.random.default_rng(3)
    for n, alphabet in ((1, 1), (1, 7), (3, 50), (4, 50257)):
        model = token_files.Model([2] * n, alphabet, 2048)
        model.count += rng.zipf(1.2, model.count.shape).clip(max=1 << 16)
        model.predict()
        sums = np.append(rng.integers(0, int(model.flat[-1]), 3000), [0, int(model.flat[-1]) - 1])
        assert (model.find(sums) == np.searchsorted(model.flat, sums, side="right") - 1).all()


def test_another_tokenizer_file_takes_the_whole_chain(tmp_path):
    kind = json.loads(Path(public_tokenizers.path(FILES[1])).read_text())
    kind["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "\\S+"}
    (tmp_path / "other.json").write_text(json.dumps(kind))
    coder = tokens.Encoder(str(tmp_path / "other.json"))
    ids, starts = coder.encode(pa.array(ODD))
    whole = [x.ids for x in coder.tokenizer.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert coder.split is None and [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == whole


@pytest.mark.parametrize("n", [0, 1, 17, 4000, 70_000])
@pytest.mark.parametrize("kind", ["random", "same", "words"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"random": rng.integers(0, 50257, n), "same": np.full(n, 50256), "words": rng.zipf(1.3, n) % 50257}[kind].astype(np.uint32)
    other = np.flip(ids)[: n // 3]
    blocks = [([3, None], np.array([n, 0]), ids), ([4], np.array([len(other)]), other)]
    data = token_files.encode_blocks(blocks, 50257, steps=64)
    # Side by side, and each by itself.
    for back in (token_files.decode_blocks(data, 50257), [token_files.decode_blocks([x], 50257)[0] for x in data]):
        assert back[0][0] == [3, None] and back[0][1].tolist() == [n, 0] and (back[0][2] == ids).all()
        assert back[1][0] == [4] and (back[1][2] == other).all()
    assert data[1] == token_files.encode_blocks(blocks[1:], 50257, steps=64)[0]


def bits(ids, **kw):
    return 8 * len(token_files.encode_blocks([([1], np.array([len(ids)]), ids)], 50257, **kw)[0]) / len(ids)


def test_bytes_of_the_format_stay():
    ids = (np.random.default_rng(8).zipf(1.2, 150_000) % 50257).astype(np.uint32)
    data = token_files.encode_blocks([([1], np.array([len(x)]), x) for x in (ids, ids[:70_000])], 50257, steps=256)
    assert [zlib.crc32(x) for x in data] == [3294967955, 58997342]  # as the coder wrote them before it was made faster


def test_coder_learns():
    assert bits(np.tile(np.arange(100, dtype=np.uint32), 2000)) < 2


def test_real_ids_take_less_than_order_0_and_zlib(spark):
    texts = spark.read.parquet(SF.replace("0.001", "0.1") + "/documents.parquet").orderBy("doc_id").limit(3000).select("text").toPandas()["text"]
    ids, _ = tokens.with_end(*tokens.Encoder(public_tokenizers.path(FILES[0])).encode(pa.array(texts)))
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    found = bits(ids)
    # What the two contexts add over order 0 of the whole, which knows all counts in advance.
    assert found < 0.95 * -(share * np.log2(share)).sum()
    assert found < 0.95 * 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


DOCS = [(5, "hello there world"), (1, None), (None, "héllo"), (3, ""), (3, ""), (9, "word " * 6000), (2, "x")]


def expected(name):
    coder = tokens.Encoder(public_tokenizers.path(name))
    return {(k, t): [*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in DOCS}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("start", F.lit("clash"))
    blocks = token_files.write_ids(df, public_tokenizers.path(FILES[0]), 50257, block_ids=8)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_ids(blocks, 50257).collect())
    at, want = 0, []
    for (key, _), ids in sorted([((k, t), expected(FILES[0])[k, t]) for k, t in DOCS], key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        want.append((at, key, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    empty = token_files.write_ids(df.where("false"), public_tokenizers.path(FILES[0]), 50257)
    assert token_files.read_ids(empty, 50257).count() == 0


def test_damage_is_found(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    blocks = token_files.write_ids(df, public_tokenizers.path(FILES[0]), 50257).withColumn("ids_crc32", F.col("ids_crc32") + 1)
    with pytest.raises(Exception, match="is damaged"):
        token_files.read_ids(blocks, 50257).collect()


def test_best_fill_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        counts = {s: sizes.count(s) for s in sizes}
        chosen = packing.best_fill(counts, 64)
        longest = max(sizes)
        rest = list(sizes)
        rest.remove(longest)
        best = max(t for m in range(1 << len(rest)) if (t := longest + sum(s for k, s in enumerate(rest) if m >> k & 1)) <= 64)
        assert sum(k * n for k, n in chosen.items()) == best
        assert all(n <= counts[k] for k, n in chosen.items()) and chosen[longest] >= 1


def test_packing(spark):
    rows = DOCS + [(100 + k, "word " * (k * 37 % 900)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(df, public_tokenizers.path(FILES[1]), pool=8).toPandas()
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        size = part["length"].sum()
        assert size == 4096 or size & (size - 1) == 0
    coder = tokens.Encoder(public_tokenizers.path(FILES[1]))
    for key, text in rows:
        ids = [*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = got[got["doc_id"].isna()] if key is None else got[got["doc_id"] == key]
        if key == 3:
            assert len(mine) == 2
            continue
        mine = mine.sort_values("start")
        assert mine["start"].tolist() == [0, *mine["length"].cumsum().tolist()[:-1]] and mine["length"].sum() == len(ids) == mine["doc_tokens"].iloc[0]
        assert [crc(ids[a : a + n]) for a, n in zip(mine["start"], mine["length"], strict=True)] == mine["ids_crc32"].tolist()
    assert packing.pack(df.where("false"), public_tokenizers.path(FILES[1])).count() == 0

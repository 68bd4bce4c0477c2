import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trekframe.llm.packing import fullest, pack, slack_plan
from trekframe.llm.sharding import assignment, document_shards, shard, write_shards
from trekframe.llm.token_matrix import CapacityTree, best_fit_plan, token_matrix
from trekframe.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def truth():
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_tokenizer(truth):
    rng = random.Random(2)
    marks = ["a", "É", "ß", "'s", "'LL", "!", "…", "0", "٣", "日", "é", "\x00", "<|endoftext|>", "x\x85", "İ", "ﬁ", "-", "'", "thing", "~", "$", "×"]
    texts = [rng.choice(["", " ", "\n\t"]).join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += ["", "  ", "The QUICK brown-fox's 2nd jump: it'll cost $3.50!!", "a" * 3000]
    assert [np.frombuffer(b, "<u4").tolist() + [1] for b in encoder(PATH).encode(texts)] == [truth(t) for t in texts]


def check_pieces(rows, found, truth, width):
    """Every token of every row in one piece, every sequence gapless and within the width."""
    wanted = sorted((str(i), k // width, k, len(t[k : k + width]), zlib.crc32(np.array(t[k : k + width], "<u4").tobytes())) for i, text, *_ in rows for t in [truth(text)] for k in range(0, len(t), width))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= width
    return len(places), sum(r.length for r in found)


def test_packing_loses_nothing(documents, rows, truth):
    found = pack(documents, PATH, max_tokens=256).collect()
    bins, tokens = check_pieces(rows, found, truth, 256)
    assert tokens == sum(len(truth(t)) for _, t, *_ in rows) and bins <= len(brute_best_fit([r.length for r in found], 256)) + 1


def test_nothing_to_pack(nothing):
    assert pack(nothing, PATH).count() == token_matrix(nothing, PATH).count() == 0


def test_matrices_hold_the_tokens(documents, rows, truth):
    wanted = {}
    for i, text, *_ in rows:
        wanted.setdefault(i, []).append(truth(text))
    total = 0
    for r in token_matrix(documents, PATH, max_tokens=200).collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 200 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for doc, piece, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert start == 200 * piece and any(t[start : start + b - a] == ids[a:b].tolist() for t in wanted[doc])
            assert positions[a:b].tolist() == list(range(b - a))
            total += b - a
    assert total == sum(len(truth(text)) for _, text, *_ in rows)


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.sampled_from([best_fit_plan, slack_plan]))
def test_plans_place_every_piece_once(lengths, plan):
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled, spans = {}, {}
    for length, first, n, times, bin_id, offset in plan(counts, 30):
        for rank in range(first, first + n):
            k = bin_id + (rank - first) // times
            at = offset + (rank - first) % times * length
            spans.setdefault(k, []).append((at, at + length))
            filled[k] = filled.get(k, 0) + length
    for used in spans.values():
        used.sort()
        assert used[0][0] == 0 and all(a[1] == b[0] for a, b in zip(used, used[1:], strict=False)) and used[-1][1] <= 30
    assert sum(filled.values()) == sum(lengths)
    if plan is best_fit_plan:
        assert sorted(30 - v for v in filled.values()) == brute_best_fit(lengths, 30)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=8))
def test_the_fullest_bin_is_the_fullest(counts):
    sums = {max(counts)}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1 - (length == max(counts))) if s + k * length <= 40}
    used = fullest(counts, 40)
    assert sum(a * b for a, b in used) == max(sums) and all(b <= counts[a] for a, b in used)


def test_capacity_tree():
    tree = CapacityTree(20)
    for room in (3, 7, 20):
        tree.mark(room, True)
    tree.mark(7, False)
    assert [tree.first_at_least(x) for x in (0, 3, 4, 20)] == [3, 3, 20, 20] and CapacityTree(5).first_at_least(0) == -1


def test_shards_are_even_and_gapless(documents, rows, nothing):
    found = document_shards(documents, 7).collect()
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert len(found) == len(rows) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((r.size, r.text_crc32) for r in found) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert document_shards(nothing).count() == 0


def test_few_keys_move_when_shards_are_added():
    counts = {c: 3 for c in range(0, 1 << 15, 5)}
    where = lambda n, slack: {(c, r): s for c, first, rows, s, _ in assignment(counts, n, 256, slack) for r in range(first, first + rows)}
    before, after = where(40, 0.25), where(41, 0.25)
    moved = sum(before[k] != after[k] for k in before)
    assert len(before) == 3 * len(counts) and moved < 0.12 * len(before)
    load = [list(before.values()).count(s) for s in range(40)]
    assert max(load) <= -(-len(before) * 5 // 4 // 40) + 1


def test_shards_can_be_written(spark, documents, tmp_path):
    write_shards(shard(documents.select("doc_id", "text"), ["doc_id"], 3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()
    assert json.dumps(sorted(p.name for p in (tmp_path / "out").glob("shard=*"))) == '["shard=0", "shard=1", "shard=2"]'

import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from sylva.llm import packing as m

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return m.tokenizer_path()


@pytest.fixture(scope="module")
def plain(path):
    return tokenizers.Tokenizer.from_file(path)


ODD = [
    "", " ", "don't it's I'LL we've 's't're x'd", "a b ́x é ñ", "x\x1cy z\x1f", "<|endoftext|> hi <|startoftext|>", "ΣΑΣ ΟΔΟΣ", "İstanbul ẞ ª º µ²³½ß", "１２３ 𝟘 12ab34 a1b", "tab\tnl\r\n\x0bvt\x0cff\x85nel em x",
    "日本語テキスト😀👍🏽", "a'b'c !!??'' --- ab--'s x't", "De%%% êeux*** ouier### A.B.C. e.g., (x) [y] {z} \\ ^ _a_ `q`", "Ÿ ÿ Œ œ", "x" * 3000, "<| not special |>", "a\x00b",
]


def test_ids(plain, path, monkeypatch):
    rng = random.Random(1)
    chars = "abcXYZéßñÀ'.,!#19 \t\n-<|>ÆΣ日́\xa0"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(400)]
    for limit in (m.CACHE, 8):  # 8: pieces are forgotten all the time
        monkeypatch.setattr(m, "CACHE", limit)
        w = m.Words(path)
        for t in texts:
            assert np.frombuffer(w.ids(t.encode()), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


HELD = """
import re, sys
sys.path.insert(0, sys.argv[2])
from tokenizers import Tokenizer
from sylva.llm.packing import Words

def used():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())))

at = [used()]
for make in (Tokenizer.from_file, Tokenizer.from_file, Words):
    held = [*globals().get("held", []), make(sys.argv[1])]
    at.append(used())
print(at[2] - at[1], at[3] - at[2])
"""


def test_a_worker_holds_the_vocabulary_once(path):
    run = subprocess.run([sys.executable, "-c", HELD, path, str(Path(m.__file__).parents[2])], capture_output=True, text=True, check=True)
    tokenizer, words = map(int, run.stdout.split())
    assert words < 0.6 * tokenizer


def check(rows, docs, plain):
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(np.array(plain.encode(t or "", add_special_tokens=False).ids + [m.END], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        # rows equal in id may come several times: each place is covered as often
        cover = defaultdict(int)
        for r in pieces[i]:
            own = [x for x in ids if len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
            assert own and r.length > 0
            for k in range(r.start, r.start + r.length):
                cover[r.doc_tokens, k] += 1
        for x in ids:
            same = sum(len(y) == len(x) for y in ids)
            assert all(cover[len(x), k] == same for k in range(len(x)))
        assert sum(r.length for r in pieces[i]) == sum(map(len, ids))
    short = 0
    for q in sequences.values():
        at = 0
        for r in sorted(q, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == q[0].tier <= m.WINDOW and at & (at - 1) == 0
        short += at < m.WINDOW
    return short


def test_pack(odd, clashing, empty, plain, path):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for df in (odd.coalesce(1), clashing.repartition(3)):
        rows = m.pack(df, path).collect()
        check(rows, docs, plain)
    assert m.pack(empty, path).count() == 0


def test_windows_and_steps(spark, plain, path, monkeypatch):
    monkeypatch.setattr(m, "POOL", 1 << 14)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(("alpha", "beta", "gamma!")) for _ in range(rng.choice((1, 30, 100, 170, 400, 400, 700, 700, 3000))))) for i in range(400)]
    p = m.Packer(2)
    w = m.Words(path)
    end = np.array([m.END], "<u4").tobytes()
    for i, t in docs:
        p.add(i, w.ids(t.encode()) + end)
    p.end()

    class Row:
        def __init__(self, r):
            self.doc_id, self.start, self.length, self.ids_crc32, self.doc_tokens, self.sequence_id, self.offset, self.tier, self.step_id = r

    rows = [Row(r) for r in p.rows]
    assert check(rows, docs, plain) < len({r.sequence_id for r in rows})
    steps, of = defaultdict(dict), defaultdict(list)
    for r in rows:
        steps[r.step_id][r.sequence_id] = r.tier
        of[r.sequence_id].append(r)
    assert max(sum(s.values()) for s in steps.values()) <= m.STEP and all(s >> 32 == 2 for s in steps)
    # documents of some length go to the tier of that length, and shorter ones only fill gaps there
    for q in of.values():
        if q[0].tier in m.TIERS:
            assert max(r.length for r in q) * 2 > q[0].tier or q[0].tier == m.TIERS[0] or sum(r.doc_tokens > r.length for r in q)
    whole = [r for r in rows if r.length == r.doc_tokens]
    own = [r.tier == m.TIERS[m.tier_of(r.length)] for r in whole if r.length > 64]
    assert sum(own) >= 0.3 * len(own) and {r.tier for r in rows} >= {1024, m.WINDOW}


def test_steps_cost_alike(path):
    """Groups of one size have the same number of tokens, and costs within a few per cent though documents come by length."""
    p = m.Packer(0)
    for i in range(6000):
        n = 20 + i // 4 if i % 2 else 30
        p.add(i, np.full(n, 5, "<u4").tobytes())
    p.end()
    cost, tokens, tier = defaultdict(int), defaultdict(int), {}
    for _, _, length, _, _, _, _, size, step in p.rows:
        cost[step] += length**2
        tokens[step] += length
        tier[step] = size
    for size in m.TIERS:
        groups = [s for s in tokens if tier[s] == size and tokens[s] == m.STEP]
        assert max([cost[s] for s in groups], default=1) <= 1.1 * min([cost[s] for s in groups], default=1)
    assert sum(t < m.STEP for t in tokens.values()) <= 3 and sum(tokens.values()) == sum(20 + i // 4 if i % 2 else 30 for i in range(6000))

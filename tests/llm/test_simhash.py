import random

import pytest
import xxhash
from cases import documents

from ticketlens.llm import simhash
from ticketlens.llm.queries import op2_simhash


def _plain(text):
    """The fingerprint by its definition, bit by bit."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not parts:
        return 0
    size = min(3, len(parts))
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + size]).encode(), 42) for i in range(len(parts) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints):
    """Least key reachable by links of at most three bits; prints by key, all pairs compared."""
    root = {}
    for key in sorted(prints):
        if key in root:
            continue
        todo = [key]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = key
                todo += [y for y in prints if y not in root and bin((prints[x] ^ prints[y]) & (2**64 - 1)).count("1") <= 3]
    return root


def test_fingerprints_by_definition():
    rng = random.Random(1)
    texts = ["", None, " \n", "one", "one two", "One TWO three", "É é É", "a b c d", "x\x1fy z"]
    texts += [" ".join(rng.choice("aB cdÉ\t\n") * rng.randint(1, 3) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for text in texts:
        assert simhash.fingerprint(text) & (2**64 - 1) == _plain(text), text


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 4])
def test_links_by_all_pairs(spark, tile_rows):
    rng = random.Random(7)
    prints = {0}
    for _ in range(25):  # clusters, some linked only over others
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    prints |= {(rng.getrandbits(48) << 16) | 0xABCD for _ in range(120)}  # one hot band
    prints |= {(rng.getrandbits(3)) << 40 | 0x1234 for _ in range(40)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    from ticketlens.llm.components import components

    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile_rows=tile_rows)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    classes = _classes({p: p for p in signed})
    assert {p: found.get(p, p) for p in signed} == classes


def test_awkward_rows(awkward, nothing, spark):
    rows = simhash.near_classes(awkward).collect()
    assert len(rows) == awkward.count()
    by_key = {}
    for r in rows:
        by_key.setdefault(r["key"], []).append(r)
    # Wordless texts have fingerprint zero and are one class; its least id is 2, null ids never are the least.
    assert {k: {(r["fp"], r["component"]) for r in by_key[k]} for k in (2, 3, 4)} == {k: {(0, 2)} for k in (2, 3, 4)}
    assert by_key[8][0]["component"] == 1 and by_key[1][0]["component"] == 1
    assert [r["component"] for r in by_key[7]] == [7, 7]
    assert {r["component"] for r in by_key[None]} == {2, None}
    assert simhash.near_classes(nothing).collect() == []


def test_query_against_all_pairs(spark, sf_dir):
    rows = op2_simhash(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {k: f"{_plain(t):016x}" for k, t in texts.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == _classes({k: _plain(t) for k, t in texts.items()})


def test_near_copies_of_one_text_are_one_class(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)] * 5 + [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 400, 40)]
    found = simhash.near_classes(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    prints = {r["key"]: r["fp"] for r in found}
    assert {r["key"]: r["component"] for r in found} == _classes(prints)

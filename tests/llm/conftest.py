"""A small corpus of awkward rows, and its tables on disk."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

PASSAGE = " ".join(f"pass{i}" for i in range(60))
BASE = [f"w{i * 7 % 50}x" for i in range(120)]
TEXTS = [
    (1, "Alpha beta gamma delta"), (2, "alpha BETA gamma  delta"), (3, None), (4, ""), (5, " \t\n "),
    (6, PASSAGE), (7, f"own start {PASSAGE} own end"), (8, f"{PASSAGE} {PASSAGE}"), (9, PASSAGE),
    (10, " ".join(BASE)), (11, " ".join(BASE[:119] + ["changed"])), (12, " ".join(BASE)),
    (13, "one"), (14, "one two"), (15, "É ñ ö über Straße " * 9), (16, "word " * 30_000 + "tail"),
    (17, "Alpha beta gamma delta"), (17, "Alpha beta gamma delta"), (18, "same id"), (18, "other text"),
    (None, "no id here"), (None, "Alpha beta gamma delta"), (-5, "minus five"), (19, "nul\x00byte and ퟿ end"),
]
CLASHING = ("key", "fp", "block", "row", "epoch", "slot", "n_tokens", "__score", "__fp", "__sha", "__suspect", "__id", "__hits_0",
            "label", "held_out", "cell", "c0", "a.b")


def write(folder, name, columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    ids, texts = zip(*TEXTS)
    n = len(TEXTS)
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()),
               "lang": pa.array([None] * n, pa.string()), "source": pa.array([None if i % 5 == 0 else f"s{i % 3}" for i in range(n)]),
               "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
    columns |= {c: pa.array([f"{c}-{i}" for i in range(n)]) for c in CLASHING}
    write(folder, "documents", columns)
    items = [("b1", "Pass0 pass1, pass2 pass3 pass4 pass5 pass6 pass7 pass8 pass9 PASS10"), ("b2", "same id"), ("b3", None), ("b4", ""),
             ("b1", "minus five"), (None, "other text"), ("b9", "never seen anywhere")]
    write(folder, "benchmark", {"item_id": pa.array([a for a, _ in items]), "text": pa.array([b for _, b in items]), "doc_id": list(range(7))})
    write(folder, "labels", {"doc_id": pa.array([1, 2, 6, 10, 13, 14, None, 99, 1], pa.int64()),
                             "quality": pa.array([1, 1, 0, 1, 0, None, 1, 0, 1], pa.int64()),
                             "toxic": pa.array([0, 0, 1, 0, 1, None, 1, 0, 0], pa.int64())})
    vectors = [[0.5, 0.25, -1.0], [0.5, 0.25, -1.0], None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [2.0, 1.0, 0.5], [0.0, -3.0, 0.25]]
    write(folder, "embeddings", {"vec_id": pa.array([1, 1, 2, 3, 4, 5, None, -7], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())),
                                 "component": list(range(8)), "v": list(range(8)), "whitened": list(range(8))})
    pages = [(1, "http://a/", None), (2, None, ""), (None, "http://b/", "<p>unclosed"), (4, "u", "<article><h1>A &amp; b</h1><p>C\n d.</article>"),
             (4, "u", "<article><h1>A &amp; b</h1><p>C\n d.</article>"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<article><p>" + "long words here. " * 40_000 + "</article>")]
    write(folder, "pages", {"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages]),
                            "html": pa.array([p[2] for p in pages]), "text": [f"t{i}" for i in range(7)], "__main": list(range(7)), "kept": list(range(7))})
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, odd_dir):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        table = pq.read_table(f"{odd_dir}/{name}.parquet")
        pq.write_table(table.slice(0, 0), f"{folder}/{name}.parquet")
    return str(folder)

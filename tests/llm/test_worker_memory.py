"""What the tokenizers keep in a worker goes when another operator's task starts."""
import public_tokenizers
import pyarrow as pa

from eventlens.llm import common, decontaminate, language, near_copies
from eventlens.llm.token_ids import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _bytes_used() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_memory_goes_back():
    texts = pa.array([" ".join(f"w{i * 7919 % 1000003}x{i}" for i in range(k, k + 2000)) for k in range(0, 200000, 2000)])
    ids = [x[2].tolist() for x in encoder(PATH).encode(texts)]
    assert encoder(PATH) is encoder(PATH)  # kept between tasks
    before = _bytes_used()
    common.drop_worker_memory()
    assert not common.WORKER_MEMORY and before - _bytes_used() > 20 << 20
    assert [x[2].tolist() for x in encoder(PATH).encode(texts)] == ids
    common.drop_worker_memory()


def test_other_operators_tasks_drop_it(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a text of some words in it", "en") for i in range(8)], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(1, "some other words that are looked for here")], "item_id bigint, text string")
    tasks, kind = [], type(docs)
    through = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: tasks.append(f) or through(self, f, *a, **k))
    language.predict(docs, language.train(docs))
    near_copies.sketches(docs)
    near_copies.multisets(docs)
    decontaminate.find_leaks(docs, items)
    assert len(tasks) == 5
    for task in tasks:
        encoder(PATH)
        assert common.WORKER_MEMORY
        assert list(task(iter([]))) == [] and not common.WORKER_MEMORY

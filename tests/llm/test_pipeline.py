"""The pipeline stage by stage on odd rows: what each keeps, against brute force on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
from dockwatch.llm import toxicity
from dockwatch.session import stage


def test_stages(spark, docs, tmp_path):
    ids = [r["doc_id"] for r in docs.collect()]
    labels = spark.createDataFrame([(i, int(k % 3 == 0)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, work in cp.STAGES:
        before = [r.asDict() for r in rows.collect()]
        columns = rows.columns
        rows = stage(work(spark, rows, str(tmp_path)), "t")
        after = [r.asDict() for r in rows.collect()]
        seen[name] = (before, after)
        if name != "packing":
            assert rows.columns == columns
    whole = lambda r: tuple(sorted((k, str(v)) for k, v in r.items()))

    before, after = seen["toxicity"]
    model = toxicity.fit(spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string"),
                         labels)
    score = dict(zip([r["text"] for r in before], model.scores([r["text"] for r in before])))
    assert Counter(map(whole, after)) == Counter(whole(r) for r in before if score[r["text"]] < 0.5)

    before, after = seen["simhash"]
    words = [(r["text"] or "").lower().encode().split() for r in before]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for r, g in zip(before, group):
        ids[g].append(r["doc_id"])
    some = [min((i for i in m if i is not None), default=None) for m in ids.values()]
    assert Counter(r["doc_id"] for r in after) == Counter(some) and len(after) < len(before)

    before, after = seen["substring"]
    words = [(r["text"] or "").encode().split() for r in before]
    places = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(before, words):
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if places[tuple(w[i:i + 35])] > 1:
                keep[i:i + 35] = [False] * 35
        if not all(keep):
            text = b" ".join(x for x, k in zip(w, keep) if k).decode()
            r = r | {"text": text, "n_chars": len(text)}
        want[whole(r)] += 1
    assert Counter(map(whole, after)) == want

    before, after = seen["mixing"]
    had, has = Counter(map(whole, before)), Counter(map(whole, after))
    assert set(has) <= set(had) and all(n <= 3 * had[k] for k, n in has.items())

    before, after = seen["packing"]
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
    fill = Counter()
    for r in after:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2

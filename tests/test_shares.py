import hashlib

from corpuslab.operators import sampling as S


def test_trim_to_shares(spark):
    """Targets are shares of the whole table's amount, so twice the input leaves about twice as much."""
    for n in (300, 600):
        rows = [(i, ("a", "b", "c", None)[(i % 7 > 3) + (i % 11 > 8) + (i % 50 == 0)], i % 13) for i in range(n)]
        total = sum(r[2] for r in rows)
        wanted = {}
        for lang, share in (("a", 0.3), ("b", 0.25), ("c", None), (None, None)):
            left = total if share is None else int(total * share)
            for i, _, size in sorted((r for r in rows if r[1] == lang), key=lambda r: hashlib.md5(f"42:{r[0]}".encode()).hexdigest()):
                if left > 0:
                    wanted[i] = min(size, left)
                    left -= size
        df = spark.createDataFrame(rows, "id bigint, lang string, size bigint")
        found = {r.id: r.kept for r in S.trim_to_shares(df, "lang", "id", "size", {"a": 0.3, "b": 0.25}).collect()}
        assert found == wanted and len(found) < n
        assert sum(found[i] for i, lang, _ in rows if lang == "a" and i in found) == int(total * 0.3)

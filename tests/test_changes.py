"""Snapshot differences and the incremental index against plain versions."""

from collections import Counter, defaultdict

from faultgrain.operators import changes, corpus
from faultgrain.operators.spans import HANDLERS
from faultgrain.sources import snapshot

TEXT = "int f(int a) {\n}\n"


def frozen(spark, root, name, files):
    return snapshot.freeze(spark.createDataFrame(list(files.items()), "path string, content string").repartition(3), str(root), name)


def plain_diff(old, new):
    rows = {(p, "changed", None) for p in old.keys() & new.keys() if old[p] != new[p]}
    gone, come = defaultdict(list), defaultdict(list)
    for p in sorted(old.keys() - new.keys()):
        gone[old[p]].append(p)
    for p in sorted(new.keys() - old.keys()):
        come[new[p]].append(p)
    for content in gone.keys() | come.keys():
        g, c = gone[content], come[content]
        n = min(len(g), len(c))
        rows |= {(b, "moved", a) for a, b in zip(g, c)}
        rows |= {(p, "removed", None) for p in g[n:]} | {(p, "added", None) for p in c[n:]}
    return rows


def states():
    old = {f"a/{i}.c": f"{TEXT}// {i}" for i in range(20)} | {f"e/{i}.py": "" for i in range(9)} | {"n.c": None, "m.c": None, "é.go": "x"}
    new = dict(old)
    for i in range(5):
        del new[f"e/{i}.py"]
    for i in range(7):
        new[f"z/{i}.py"] = ""
    new["a/1.c"] = "other"
    new["a/2.c"] = None
    new["b/3.c"] = new.pop("a/3.c")
    new["é.c"] = new.pop("é.go")
    del new["a/4.c"], new["n.c"]
    new["new.rs"], new["k.c"] = "fn a() {}\n", None
    return old, new


def test_diff(spark, tmp_path):
    old, new = states()
    got = changes.diff(frozen(spark, tmp_path, "1", old), frozen(spark, tmp_path, "2", new))
    assert got.columns == ["path", "change", "old_path"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_diff(old, new)
    assert Counter(r[1] for r in rows) == {"moved": 5 + 1 + 1 + 1, "added": 2 + 1, "changed": 2, "removed": 1}
    same = frozen(spark, tmp_path, "3", old)
    assert changes.diff(same, same).count() == 0
    nothing = frozen(spark, tmp_path, "4", {"a.c": "x"}).filter("path = ''")
    assert {r.change for r in changes.diff(nothing, same).collect()} == {"added"}


def test_only_new_contents_are_parsed(spark, tmp_path):
    old, new = states()
    del old["n.c"], old["m.c"], new["m.c"], new["k.c"], new["a/2.c"]  # contents that are missing have no index
    new |= {f"same/{i}.c": "int same(int a) {\n}" for i in range(6)}
    before, after = frozen(spark, tmp_path, "1", old), frozen(spark, tmp_path, "2", new)
    read = spark.sparkContext.accumulator(0)

    def counted(handler):
        def run(files):
            def each(batches):
                for batch in batches:
                    read.add(len(batch))
                    yield batch

            kept = files.select("path", "language", "content")
            return handler(kept.mapInPandas(each, kept.schema))

        return run

    handlers = {language: HANDLERS[language] for language in ("c", "python")} | {"rust": HANDLERS["rust"]}
    whole = {r.path: r for r in corpus.build_index(after, handlers).collect()}
    index = corpus.build_index(before, handlers)
    got = {r.path: r for r in changes.refresh_index(before, index, after, handlers).collect()}
    assert got == whole and len(got) == len([p for p in new])
    reused, todo = changes.unparsed(before, index, after)
    # "x" was Go and is C now; the six like files are one content.
    assert {r.path for r in todo.collect()} == {"a/1.c", "new.rs", "é.c", *(f"same/{i}.c" for i in range(6))}
    assert reused.count() + todo.count() == len(got)
    changes.refresh_index(before, index, after, handlers | {"python": counted(HANDLERS["python"])}).count()
    assert read.value == 0  # no Python file is new


def test_only_files_with_another_content_are_looked_up_by_it(spark, tmp_path, monkeypatch):
    old, new = states()
    del old["n.c"], old["m.c"], new["m.c"], new["k.c"], new["a/2.c"]
    before, after = frozen(spark, tmp_path, "1", old), frozen(spark, tmp_path, "2", new)
    looked_up, lookup = [], changes.lookup

    def counted(fact, *rest, **named):
        looked_up.append({r.path for r in fact.collect()})
        return lookup(fact, *rest, **named)

    monkeypatch.setattr(changes, "lookup", counted)
    reused, todo = changes.unparsed(before, corpus.build_index(before), after)
    other = {path for path, content in new.items() if old.get(path) != content}
    assert looked_up == [other] and len(other) < len(new) / 2
    assert reused.count() == len(new) - todo.count()


def test_a_path_named_twice_or_without_an_index_row_gives_one_row(spark, tmp_path):
    old, new = states()
    del old["n.c"], old["m.c"], new["m.c"], new["k.c"], new["a/2.c"]
    before, after = frozen(spark, tmp_path, "1", old), frozen(spark, tmp_path, "2", new)
    index = corpus.build_index(before)
    again = "path IN ('a/5.c', 'a/3.c', 'e/7.py')"
    got = changes.refresh_index(
        before.unionByName(before.filter(again)), index.unionByName(index.filter(again)).filter("path != 'a/6.c'"), after
    )
    plain = sorted(map(str, corpus.build_index(after).collect()))
    assert sorted(map(str, got.collect())) == plain and len(plain) == len(new)

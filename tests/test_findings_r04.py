"""Cases of the fourth round's findings that failed before."""


def test_columns_of_a_store_may_have_the_names_of_its_folds(spark, tmp_path):
    """Columns at, of_at and v, under rules that collect rows and under those of one end, which collect none."""
    from tessera.sources.versioned import VersionedStore

    schema = "k long, at long, of_at string, v array<string>"
    rounds = [[(1, 5, "b", ["b"]), (1, 4, "a", ["a"]), (2, 1, None, None)], [(1, 3, "", ["c"]), (2, 2, "z", ["z"])]]
    for name, rules, v in (("list", {"v": "append"}, ("a", "b", "c")), ("ends", {}, ("c",))):
        store = VersionedStore(spark, f"file://{tmp_path}/{name}", schema, ["k"], rules, ["at"])
        for rows in rounds:
            store.commit(spark.createDataFrame(rows, schema))
        plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list(") == (name == "list")
        store.compact()
        got = {(r["k"], r["at"], r["of_at"], tuple(r["v"])) for r in store.read().collect()}
        assert got == {(1, 3, "b", v), (2, 2, "z", ("z",))}


def _inbox(tmp_path, names):
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f'{{"title": "{name}"}}' if name.endswith(".json") else "abc")
    return f"file://{tmp_path}"


def test_kinds_of_an_inbox_are_counted_without_sidecars_or_names_on_the_driver(spark, tmp_path, monkeypatch):
    from tessera import plans
    from tessera.plans import stores
    from tessera.sources import files

    monkeypatch.setattr(files, "BATCH", 2, raising=False)
    deep = "/".join("abcdefg")
    folder = _inbox(tmp_path, ["x.mp4", "a/x.mp4", "a/x.jpg", "a/x.meta.json", "b/x.meta.json", "c.d/y", f"{deep}/y.wav", "a/_z.wav", ".b/z.wav", "_c=1/z.wav"])
    (tmp_path / "none.wav").write_text("")
    monkeypatch.setattr(stores, "_inbox", lambda *_: folder)
    rows = plans.QUERIES["a24_inbox"](spark, "")
    assert sorted((r.kind, r.n, r.bytes) for r in rows.collect()) == [("audio", 2, 6), ("image", 1, 3), ("video", 2, 6)]
    assert rows.inputFiles() == [] and "binaryFile" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == files.LEVELS + 1


def test_a_library_pairs_files_with_sidecars_of_their_folder(spark, tmp_path, monkeypatch):
    from tessera.sources import files

    monkeypatch.setattr(files, "HELD", 20, raising=False)
    deep = "/".join("abcdefg")
    folder = _inbox(tmp_path, ["x.mp4", "a/x.mp4", "a/x.jpg", "a/x.meta.json", "b/x.MOV", "b/x.meta.json", f"{deep}/y.wav", f"{deep}/y.meta.json", "e/x.y.png", "e/x.meta.json"])
    rows = files.library(spark, folder, "title string")
    got = sorted(((r["name"], r.kind, r.bytes, r.title) for r in rows.collect()), key=str)
    a, b, y = "a/x.meta.json", "b/x.meta.json", f"{deep}/y.meta.json"
    want = [("x.mp4", "video", 3, None), ("x.mp4", "video", 3, a), ("x.jpg", "image", 3, a), ("x.MOV", "video", 3, b), ("y.wav", "audio", 3, y), ("x.y.png", "image", 3, None)]
    assert got == sorted(want, key=str)
    assert rows.inputFiles() == []  # the driver holds no names

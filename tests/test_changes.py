from graphloom.operators import changes, store


def test_owners_of_change(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    one = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    targets = one(["//:r", "//a:x", "//a:y", "//a/b:z", "//c:w", "//d:v"], "address")
    files = spark.createDataFrame([("rules/lib.js", "lib"), ("rules/deep.js", "deep"), ("rules/top.js", "top"), ("a/BUILD.js", "a/BUILD.js")], "path string, module string")
    imports = spark.createDataFrame([("lib", "deep"), ("c/BUILD.js", "lib"), ("d/BUILD.js", "deep"), ("deep", "lib"), ("imp.workspace.js", "top"), ("c/BUILD.js", "a/BUILD.js")], "src string, dst string")
    scopes = spark.createDataFrame([("c/BUILD.js", "//c"), ("d/BUILD.js", "//d"), ("a/BUILD.js", "//a")], "module string, scope string")
    every = {r["address"] for r in targets.collect()}
    for changed, want in [
        (["rules/deep.js"], {"//c:w", "//d:v"}), (["a/BUILD.js"], {"//a:x", "//a:y"}), (["BUILD.js", "none.txt"], {"//:r"}), (["rules/top.js"], every),
        (["imp.workspace.ci.js"], every), (["none.txt"], set()), ([], set()), (["sub/imp.workspace.js"], set()),
    ]:
        got = changes.owners_of_change(targets, files, imports, scopes, one(changed, "path")).collect()
        assert sorted(r["address"] for r in got) == sorted(want), changed


def test_lock_resolve(spark):
    lock = '{"tool": "t", "versions": {"1": {"p": {"url": "u", "sha256": "s"}, "q": {"url": "u"}}, "2": {}}}'
    files = spark.createDataFrame([("//l", lock), ("//bad", "{"), ("//null", None)], "address string, contents string")
    asked = [("//l", "t", "1", "p"), ("//no", "t", "1", "p"), ("//null", "t", "1", "p"), ("//bad", "t", "1", "p"), ("//l", "o", "9", "p"), ("//l", "t", "9", "p"), ("//l", "t", "1", "q"), ("//l", "t", "2", "p")]
    want = [None, "no lock file", "no lock file", "not valid JSON", "other tool", "unlocked version", "unlocked platform", "unlocked platform"]
    for unverified in (True, False):
        df = spark.createDataFrame([(*a, unverified) for a in asked], "address string, tool string, version string, platform string, unverified boolean")
        got = {tuple(r)[:4]: (r["url"], r["sha256"], r["reason"], r["fails"]) for r in store.lock_resolve(df, files).collect()}
        assert got == {a: ("u", "s", None, False) if w is None else (None, None, w, not unverified) for a, w in zip(asked, want, strict=True)}

"""OBJ text in ranges of bytes, with groups and materials, against a plain reading from top to bottom."""

import random

from cellforge.operators.scan import carried_scan
from cellforge.sources import obj


def plain(text):
    v, n, faces, now = [], {"v": 0, "vt": 0, "vn": 0}, [], {"o": None, "g": None, "usemtl": None}
    for line in text.split("\n"):
        p = line.split()
        if not p:
            continue
        if p[0] == "v":
            v.append(tuple(map(float, p[1:4])))
        if p[0] in n:
            n[p[0]] += 1
        if p[0] in now:
            now[p[0]] = line.strip()[len(p[0]) :].strip()
        if p[0] == "f":
            at = [int(c.split("/")[0]) for c in p[1:]]
            at = [n["v"] + i if i < 0 else i - 1 for i in at]
            faces += [(len(faces) + k, at[0], at[k + 1], at[k + 2], now["o"], now["g"], now["usemtl"]) for k in range(len(at) - 2)]
    return v, [(i, *f[1:]) for i, f in enumerate(faces)]


def test_files_are_read_by_ranges(spark, tmp_path):
    random.seed(21)
    texts = {}
    for name in ("one", "two"):
        lines = ["# head", "mtllib x.mtl"]
        for i in range(1500):
            lines.append(f"v {i} {i / 2} -{i}")
            if i % 3 == 0:
                lines.append("vt 0 1")
            if i > 5 and random.random() < 0.6:
                lines.append("f " + " ".join(str(-random.randint(1, 6)) if random.random() < 0.5 else f"{random.randint(1, i)}/1" for _ in range(random.randint(3, 6))))
            if random.random() < 0.02:
                lines.append(random.choice(["usemtl  red wood ", "usemtl blue", "g a b", "o thing", "g"]))
        texts[name] = "\n".join(lines)
        (tmp_path / f"{name}.obj").write_text(texts[name])
    settings = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        assert obj.text_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        v, f = obj.read_obj(spark, str(tmp_path), marks=True)
        got_v, got_f = v.collect(), f.collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    for name, text in texts.items():
        want_v, want_f = plain(text)
        assert [(r.x, r.y, r.z) for r in sorted(got_v, key=lambda r: r.vertex_id) if r.mesh == name] == want_v
        assert sorted(r.vertex_id for r in got_v if r.mesh == name) == list(range(len(want_v)))
        assert sorted((r.face_id, r.v0, r.v1, r.v2, r.object, r.group, r.material) for r in got_f if r.mesh == name) == want_f


def test_material_libraries(spark):
    text = "# colours\nKd 9 9 9\nnewmtl red\nKd 1 0 0\nNs 10\n\nnewmtl blue wood\nKd 0 0 1\nmap_Kd wood one.png\nKd 0 0 0.5"
    lines = spark.createDataFrame([("m", i, x) for i, x in enumerate(text.split("\n"))] + [("n", 0, "newmtl red"), ("n", 1, "d 0.5")], "mesh string, line_no int, line string")
    assert {tuple(r) for r in obj.parse_mtl(lines).collect()} == {("m", "red", "Kd", "1 0 0"), ("m", "red", "Ns", "10"), ("m", "blue wood", "Kd", "0 0 0.5"), ("m", "blue wood", "map_Kd", "wood one.png"), ("n", "red", "d", "0.5")}
    assert obj.parse_obj(lines.limit(0), marks=True)[1].count() == 0


def test_carried_values_over_many_ranges(spark):
    rows = [(k, i, i % 5, str(i) if i % 37 == 3 else None) for k in ("a", None, "b") for i in range(400)]
    got = carried_scan(spark.createDataFrame(rows, "k string, i int, n int, s string").repartition(7), "k", ["i"], ["n"], ["s"]).collect()
    want = {}
    for k in ("a", None, "b"):
        total, last = 0, None
        for i in range(400):
            total, last = total + i % 5, str(i) if i % 37 == 3 else last
            want[k, i] = (total, last)
    assert {(r.k, r.i): (r.n, r.s) for r in got} == want and len(got) == len(want)

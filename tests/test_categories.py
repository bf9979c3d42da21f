import random
import re

from factloom.operators import categories as C

norm = lambda s: re.sub("[-_]", " ", (s or "").lower().strip())


def plain(title, kind, tags, paths):
    """The rules, path after path."""
    title, kind = norm(title), norm(kind)
    split = [(p, [s.strip() for s in p.lower().split("/") if s.strip()]) for p in paths]
    word = lambda s: re.search(r"(^|[^A-Za-z0-9_])" + re.escape(s) + r"([^A-Za-z0-9_]|$)", title)
    if kind:
        for p, s in split:
            if p.lower().rsplit("/", 1)[-1].strip() == kind:
                return p, 0.85
        for p, s in split:
            if any(kind in x or x in kind for x in s):
                return p, 0.75
    if title:
        for p, s in split:
            if any(len(x) >= 4 and word(x) for x in s):
                return p, 0.65
    for t in tags or []:
        for p, s in split:
            if norm(t) and norm(t) in s:
                return p, 0.60
    return None, 0.0


def result(spark, products, paths):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(products)], "id int, title string, type string, tags array<string>")
    known = spark.createDataFrame(list(enumerate(paths)), "ordinal int, path string")
    got = {r.id: (r.path, r.confidence) for r in C.detect_categories(rows, known).collect()}
    return [got[i] for i in range(len(products))]


def test_all_segments_count(spark):
    paths = ["apparel/scarves/wool", "Home/Lamps", "home/desk_lamps", "tools/c++ kits/.net", "art/a b/étui"]
    products = [
        ("Warm scarves for men", None, None), ("x", None, ["none", "Apparel"]), ("x", "SCARVES", None), ("x", "lamps", None), (None, " Wool ", []), ("WARM-SCARVES", None, None), ("scarvesx", None, None),
        ("a c++ kits set", None, None), ("c++ kitset", None, None), ("\\E.net", "", None), ("my .net", None, None), ("étui", None, None), ("desk lamps", None, None), (None, None, [None, "", "home"]), (None, None, None), ("", "", []),
        ("x", "big wool blanket", None), ("a b", None, ["a-b"]),
    ]
    got = result(spark, products, paths)
    assert got == [plain(*p, paths) for p in products]
    assert got[0] == ("apparel/scarves/wool", 0.65) and got[1] == ("apparel/scarves/wool", 0.6)


def test_many_paths_in_any_order(spark):
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "ne", "ru", "so", "ti"]
    made = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    paths = ["/".join(rng.choice([made(), made() + " " + made(), made() + "_" + made()]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    products = [(rng.choice([None, " ".join(made() for _ in range(6))]), rng.choice([None, "zz", made() + made() + made() + "q", made()]), rng.choice([None, [made(), made()]])) for _ in range(300)]
    products.append(products[0])
    assert result(spark, products, paths) == [plain(*p, paths) for p in products]


def test_nothing_known(spark):
    assert result(spark, [("a b c d", "x", ["y"])], []) == [(None, 0.0)]

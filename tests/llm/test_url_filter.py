import random
from collections import defaultdict

from pyspark.sql import functions as F

from sparrowmill.llm import url_filter as u

DATA = "/root/testdata/sf0.001"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    for c in "?#":
        rest = rest.split(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest


def rule_of(host, path):
    best = None
    for action, text in u.RULES:
        own, _, rest = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = (action, text)
    return best


def test_parts_rules_and_templates(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    odd = [None, "", "no scheme/x", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://net/de/", "x://notnet/de/", "x://a.example.net/de/81#", "a://b://c/en/", "h://com/en/\nline", "h://org?x=/es/", "h://[::1]:80/ä/É"]
    df = pages.select("page_id", "url").unionByName(spark.createDataFrame(list(enumerate(odd, 10_000)), "page_id long, url string"))
    urls = {r.page_id: r.url for r in df.collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = u.judge_urls(df.withColumns({"host": F.lit(1), "s": F.lit(2)}), labels).collect()
    assert len(rows) == len(urls)
    by_template = defaultdict(set)
    for r in rows:
        assert (r.host, r.path) == parts(urls[r.page_id])
        want = rule_of(r.host, r.path)
        assert r.rule == (want[1] if want else None)
        if want:
            assert r.verdict == want[0]
        else:
            by_template[r.host, r.template].add(r.verdict)
    assert all(len(v) == 1 for v in by_template.values())


def test_variable_segments_merge_and_impure_templates_go(spark):
    rows = [(i, f"http://h.test/blog/post-{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}/view") for i in range(400)]
    rows += [(1000 + i, f"http://h.test/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.selectExpr("page_id AS doc_id", "int(url not like '%spam%') AS quality")
    out = {(r.template, r.verdict) for r in u.judge_urls(pages, labels).collect()}
    assert out == {("/blog/<*>/view", "allow"), ("/spam/<n>", "block"), ("/news/<n>", "allow")}
    same = labels.selectExpr("doc_id", "1 AS quality")
    assert {r.template for r in u.judge_urls(pages, same).collect()} == {"/blog/<*>/view", "/<|>/<n>"}


def test_empty_tables_repeats_and_no_labels(spark):
    pages = spark.createDataFrame([(1, "h://a/b"), (1, "h://a/b"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.verdict for r in u.judge_urls(pages, labels).collect()] == ["allow"] * 3
    assert u.judge_urls(pages.limit(0), labels).count() == 0


def test_small_branches_with_labels_of_their_own_stay(spark):
    # 20 sections of 5 % each, one of them bad; and 20 whose shares are the same, but not below them.
    rows = [(i, f"http://hot.test/sec{chr(97 + i % 20)}/{i}") for i in range(800)]
    rows += [(1000 + i, f"http://mix.test/sec{chr(97 + i % 20)}/{'new' if i // 20 % 2 else 'old'}/{i}") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = "url like '%hot.test/secc/%' or url like '%mix.test/secc/new/%' or (url like '%mix.test/%/old/%' and url not like '%/secc/%')"
    labels = pages.selectExpr("page_id AS doc_id", f"int(not ({bad})) AS quality")
    out = u.judge_urls(pages, labels).join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").collect()
    assert all((r.verdict == "allow") == (r.quality == 1) for r in out)
    assert {r.template for r in out if r.host == "hot.test"} == {"/secc/<n>", "/<*>/<n>"}


def test_branches_at_any_depth_have_their_own_verdict(spark):
    rows = [(i, f"http://h.test/a/b/c/d/e/f/g/{'spam' if i % 2 else 'news'}/h/{i}") for i in range(80)]
    rows += [(1000 + i, f"http://w.test/a/b/c/d/e/f/g/post-{chr(97 + i % 26)}{chr(97 + i // 26)}/view") for i in range(80)] + [(2000, "http://t.test" + "/x" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.selectExpr("page_id AS doc_id", "int(url not like '%spam%') AS quality")
    out = {(r.template, r.verdict) for r in u.judge_urls(pages, labels).collect()}
    top = "/a/b/c/d/e/f/g/"
    assert out == {(f"{top}spam/h/<n>", "block"), (f"{top}news/h/<n>", "allow"), (f"{top}<*>/view", "allow"), ("/x" * 3000, "allow")}


def brute_templates(shapes, most_children=16, least_share=0.1, z=1.96, least_labelled=8.0):
    """{(host, shape): template} of {(host, shape): (n, labelled, good)}, every level of every host in turn."""
    t = {k: list(k[1]) for k in shapes}
    within = lambda g, n, p: abs(g / n - p) <= z * (p * (1 - p) / n) ** 0.5 + 1e-12
    for level in range(max((len(k[1]) for k in shapes), default=0)):
        nodes = defaultdict(lambda: defaultdict(list))
        for k, parts_ in t.items():
            if level < len(parts_):
                nodes[k[0], tuple(parts_[:level])][parts_[level]].append(k)
        for children in nodes.values():
            held = {seg: sum(shapes[k][0] for k in own) for seg, own in children.items()}
            small = {seg for seg, n in held.items() if len(children) > most_children and n < least_share * sum(held.values())}
            rests = defaultdict(lambda: defaultdict(lambda: [0, 0]))
            for seg in small:
                for k in children[seg]:
                    below = t[k][level + 1 :]
                    for i in range(len(below) + 1):
                        if shapes[k][1]:
                            rests[tuple(below[:i])][seg][0] += shapes[k][2]
                            rests[tuple(below[:i])][seg][1] += shapes[k][1]
            apart = set()
            for by in rests.values():
                p = sum(g for g, _ in by.values()) / sum(n for _, n in by.values())
                apart |= {seg for seg, (g, n) in by.items() if n >= least_labelled and not within(g, n, p)}
            for seg in small - apart:
                for k in children[seg]:
                    t[k][level] = "<*>"
    for level in range(max((len(k[1]) for k in shapes), default=0)):
        frames = defaultdict(lambda: defaultdict(list))
        for k, parts_ in t.items():
            if level < len(parts_):
                frames[k[0], len(parts_), tuple(parts_[:level]), tuple(parts_[level + 1 :])][parts_[level]].append(k)
        for by in frames.values():
            sums = {seg: (sum(shapes[k][2] for k in own), sum(shapes[k][1] for k in own)) for seg, own in by.items()}
            all_g, all_n = sum(g for g, _ in sums.values()), sum(n for _, n in sums.values())
            for seg, (g, n) in sums.items():
                if len(by) > 1 and (n == 0 or within(g, n, all_g / all_n)):
                    for k in by[seg]:
                        t[k][level] = "<|>"
    return {k: tuple(v) for k, v in t.items()}


def brute_verdicts(pages, labels):
    """{page_id: (verdict, template)} without rules; a page's shape is taken from the column expression's twin."""
    import re

    def shape(path):
        path = re.sub(r"(?i)(?<![0-9a-z])(?=[0-9a-f-]*[0-9])[0-9a-f-]{16,}(?![0-9a-z])", "<hex>", path)
        return tuple(re.sub(r"^/", "", re.sub(r"[0-9]+", "<n>", path)).split("/"))

    where = {i: (parts(url)[0], shape(parts(url)[1])) for i, url in pages}
    shapes = defaultdict(lambda: [0, 0, 0])
    for i, k in where.items():
        shapes[k][0] += 1
        if i in labels:
            shapes[k][1] += 1
            shapes[k][2] += labels[i]
    templates = brute_templates(shapes)
    p = sum(v[2] for v in shapes.values()) / max(1, sum(v[1] for v in shapes.values())) if any(v[1] for v in shapes.values()) else 1.0
    sums = defaultdict(lambda: [0, 0])
    for k, v in shapes.items():
        sums[k[0], templates[k]][0] += v[2]
        sums[k[0], templates[k]][1] += v[1]
    out = {}
    for i, k in where.items():
        good, labelled = sums[k[0], templates[k]]
        out[i] = ("allow" if (good + 8 * p) / (labelled + 8) >= 0.5 else "block", "/" + "/".join(templates[k]))
    return out


def test_tree_and_verdicts_equal_brute_force(spark):
    rng = random.Random(5)
    pages, labels = [], {}
    for i in range(3000):
        host = rng.choice(["a.test", "b.test", "b.test", "c.test"])
        top = rng.choice(["blog", "shop", "spam"] + [f"s{chr(97 + j)}" for j in range(22)])
        rest = rng.choice([[f"p-{chr(97 + rng.randrange(26))}"], [f"p-{chr(97 + rng.randrange(26))}", "view"], [str(i), rng.choice("xyz")], [rng.choice(["one", "two"]), "deep", rng.choice("uvw"), str(i)]])
        pages.append((i, f"http://{host}/{'/'.join([top, *rest])}"))
        if rng.random() < 0.6:
            labels[i] = int(rng.random() < (0.1 if top == "spam" or "deep" in rest and host == "b.test" else 0.9))
    found = u.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), rules=[]).collect()
    want = brute_verdicts(pages, labels)
    assert {r.page_id: (r.verdict, r.template) for r in found} == want
    assert {v for v, _ in want.values()} == {"allow", "block"} and {x for _, t in want.values() for x in ("<*>", "<|>") if x in t} == {"<*>", "<|>"}


def test_jobs_do_not_follow_the_depth_of_paths(spark):
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for depth in (4, 2000):
        base = ["abcdefg"[i % 7] for i in range(depth)]
        urls = ["http://h.test/" + "/".join([*base[:-1], last]) for last in "ab"]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        spark.sparkContext.setJobGroup(f"urls {depth}", "")
        found = u.judge_urls(pages, spark.createDataFrame([], "doc_id long, quality int")).collect()
        jobs[depth] = len(tracker.getJobIdsForGroup(f"urls {depth}"))
        assert {r.template for r in found} == {"/" + "/".join([*base[:-1], "<|>"])}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[4] == jobs[2000]

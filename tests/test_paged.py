import json
import os
from pathlib import Path
from urllib.parse import unquote

import pytest

from tidewheel.sources import commits, feeds, paged


def fetch(url):
    """An upstream in a folder: five pages by cursor or 250 rows by offset. Calls are noted; page 3 fails while a file ``broken`` is there."""
    root, _, rest = url.removeprefix("fake://").partition("?")
    kind, cursor = rest.split("=")
    cursor = unquote(cursor)
    folder = Path("/" + root)
    with open(folder / f"calls-{kind}", "a") as f:
        f.write(cursor + "\n")
    if kind == "works":
        page = 1 if cursor == "*" else int(cursor.removeprefix("c/"))
        if page == 3 and os.path.exists(folder / "broken"):
            raise TimeoutError("no answer")
        work = {"id": f"https://x/W{page}", "display_name": f"Title {page}", "publication_date": "2024-01-02"}
        return json.dumps({"results": [work], "meta": {"next_cursor": f"c/{page + 1}" if page < 5 else None}})
    rows = [{"doi": f"10.1/{k}", "title": f"T{k}", "date": "2024-01-02"} for k in range(int(cursor), min(250, int(cursor) + 100))]
    return json.dumps({"collection": rows, "messages": [{"total": "250"}]})


def specs(spark, tmp_path, budget=2):
    return spark.createDataFrame([("works", "research", f"fake://{str(tmp_path)[1:]}?works={{cursor}}", "cursor", budget), ("server", "research", f"fake://{str(tmp_path)[1:]}?rows={{cursor}}", "offset", None)], "source string, section string, url string, style string, budget int")


def calls(tmp_path, kind):
    return (tmp_path / f"calls-{kind}").read_text().split()


def test_walks_resume_after_a_failed_page(spark, tmp_path):
    at = commits.Tables(spark, str(tmp_path / "t"))
    wanted = specs(spark, tmp_path)
    had = lambda source: [r.page for r in at.read("pages").where(f"source = '{source}'").orderBy("page").collect()]
    paged.pull(at, wanted, "tests.test_paged:fetch")
    assert had("works") == [1, 2] and had("server") == [1, 2, 3]
    (tmp_path / "broken").touch()
    paged.pull(at, wanted, "tests.test_paged:fetch")
    assert had("works") == [1, 2]
    assert [r.error for r in at.read("walks").where("error is not null").collect()] == ["TimeoutError: no answer"]
    (tmp_path / "broken").unlink()
    for pages in ([1, 2, 3, 4], [1, 2, 3, 4, 5]):
        paged.pull(at, wanted, "tests.test_paged:fetch")
        assert had("works") == pages
    version = at.state().version
    assert paged.pull(at, wanted, "tests.test_paged:fetch").version == version  # all is read
    assert calls(tmp_path, "works") == ["*", "c/2", "c/3", "c/3", "c/4", "c/5"]
    assert calls(tmp_path, "rows") == ["0", "100", "200"]
    pages = at.read("pages")
    assert sorted(r.title for r in feeds.openalex(pages.where("source = 'works'")).collect()) == [f"Title {k}" for k in range(1, 6)]
    assert feeds.preprints(pages.where("source = 'server'")).select("external_id").distinct().count() == 250


def test_a_crash_before_the_commit_repeats_the_pull(spark, tmp_path, monkeypatch):
    at = commits.Tables(spark, str(tmp_path / "t"))
    with monkeypatch.context() as m:
        m.setattr(commits.Tables, "_publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError, match="crash"):
            paged.pull(at, specs(spark, tmp_path), "tests.test_paged:fetch")
    assert at.read("pages") is None
    paged.pull(at, specs(spark, tmp_path), "tests.test_paged:fetch")
    assert at.read("pages").count() == 5 and at.read("cursors").count() == 2


def test_of_two_pulls_one_is_refused(spark, tmp_path, monkeypatch):
    at, other = (commits.Tables(spark, str(tmp_path / "t")) for _ in range(2))
    wanted = specs(spark, tmp_path)
    paged.pull(at, wanted, "tests.test_paged:fetch")
    before = at.state()
    paged.pull(other, wanted, "tests.test_paged:fetch")
    own, stale = at.state, [before]
    monkeypatch.setattr(at, "state", lambda *a: stale.pop() if stale else own(*a))  # what the slower one had read
    with pytest.raises(commits.Conflict):
        paged.pull(at, wanted, "tests.test_paged:fetch")
    assert [r.page for r in other.read("pages").where("source = 'works'").orderBy("page").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize(
    ("style", "page", "cursor", "after"),
    [
        ("cursor", {"results": [1], "meta": {"next_cursor": "b"}}, "a", "b"),
        ("cursor", {"results": [1], "meta": {"next_cursor": "a"}}, "a", None),
        ("cursor", {"results": [], "meta": {"next_cursor": "b"}}, "a", None),
        ("cursor", {"results": [1], "meta": None}, "a", None),
        ("offset", {"collection": [1, 2], "messages": [{"total": 5}]}, "2", "4"),
        ("offset", {"collection": [1, 2], "messages": [{"total": "4"}]}, "2", None),
        ("offset", {"collection": [1, 2], "messages": [{"total": "many"}]}, "2", None),
        ("offset", {"collection": [1]}, "0", None),
        ("offset", {}, "0", None),
    ],
)
def test_the_page_after(style, page, cursor, after):
    assert paged.following(style, page, cursor) == after


def test_walks_of_odd_answers():
    spec = {"source": "s", "section": "r", "url": "u={cursor}", "style": "cursor", "budget": 3, "cursor": "*", "page": 0}
    assert [(r["finished"], r["json"], r["error"]) for r in paged.walk(lambda u: None, spec)] == [(True, None, None)]
    assert [r["error"][:15] for r in paged.walk(lambda u: "no json", spec)] == ["JSONDecodeError"]
    assert [r["error"] for r in paged.walk(lambda u: "{}", spec | {"style": "odd"})] == ["ValueError: unknown style 'odd'"]
    assert not list(paged.walk(lambda u: "{}", spec | {"budget": 0}))

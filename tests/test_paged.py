import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessella.sources import json_map, paged

ITEMS = [{"id": n, "title": f"t{n}", "body": f"b{n}", "updated_at": f"2024-01-{n + 1:02d}T00:00:00Z"} for n in range(7)]


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            seen.append((self.path, self.headers.get("Authorization"), self.headers.get("X-Key")))
            if url.path == "/busy" and sum(p.startswith("/busy") for p, _, _ in seen) < 3:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                return self.end_headers()
            if url.path in ("/missing", "/broken"):
                self.send_response(404 if url.path == "/missing" else 500)
                return self.end_headers()
            if url.path == "/token":
                a = int(q.get("pageToken", "0"))
                body = {"data": ITEMS[a : a + 3], "nextPageToken": str(a + 3) if a + 3 < len(ITEMS) else ""}
            elif url.path == "/page":
                a = (int(q["page"]) - 1) * int(q["per_page"])
                body = {"results": ITEMS[a : a + int(q["per_page"])]}
            elif url.path == "/offset":
                a = int(q["offset"])
                body = {"deep": {"list": ITEMS[a : a + int(q["limit"])]}}
            else:
                body = ITEMS[:2]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


@pytest.mark.parametrize("options,found", [
    ({"list_path": "/plain"}, 2), ({"list_path": "/token", "page_mode": "token"}, 7), ({"list_path": "/page, /plain", "page_mode": "page", "page_size": "3", "max_pages": "9"}, 7 + 2),
    ({"list_path": "/offset", "page_mode": "offset", "page_size": "2", "items_path": "/deep/list"}, 7), ({"list_path": "/token", "page_mode": "token", "max_pages": "2"}, 6),
    ({"list_path": "/busy"}, 2), ({"list_path": "/missing"}, 0),
])
def test_pages_are_read_to_their_end(spark, server, options, found):
    bodies = paged.read_pages(spark, {"base_url": server[0], **options})
    items = json_map.find_items(bodies, "body", options.get("items_path", ""))
    docs = json_map.documents(items, json_map.Mapping("/id", "/title", "/body", "", "/updated_at"))
    assert docs.count() == found


def test_who_asks_and_what_fails(spark, server):
    for options, at, want in (
        ({"auth_mode": "bearer", "token": "tok"}, 1, "Bearer tok"), ({"auth_mode": "basic", "email": "a", "password": "b"}, 1, "Basic YTpi"), ({"auth_mode": "header", "header_name": "X-Key", "api_key": "k"}, 2, "k"),
    ):
        paged.read_pages(spark, {"base_url": server[0], "list_path": "/plain", **options}).collect()
        assert server[1][-1][at] == want
    paged.read_pages(spark, {"base_url": server[0], "list_path": "/plain", "since_param": "since", "since": "2024-01-02"}).collect()
    assert server[1][-1][0] == "/plain?since=2024-01-02"
    with pytest.raises(Exception, match="failed .500"):
        paged.read_pages(spark, {"base_url": server[0], "list_path": "/broken"}).collect()
    with pytest.raises(ValueError):
        paged.authorization({"auth_mode": "magic"})


def test_issues_files_and_boards(spark):
    def bodies(*docs):
        return spark.createDataFrame([(json.dumps(d),) for d in docs], "body string")

    adf = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "one "}, {"type": "text", "text": "two"}]}]}
    issue = {"key": "A-1", "fields": {"summary": "Sum", "status": {"name": "Open"}, "assignee": None, "description": adf, "updated": "2024-01-02T03:04:05.000+0000", "comment": {"comments": [{"body": adf}, {"body": "plain"}]}}}
    got = paged.jira_documents(bodies({"issues": [issue, {"key": "A-2", "fields": {"summary": ""}}]})).orderBy("external_id").collect()
    assert got[0].text == "Sum\n\nStatus: Open\n\nAssignee: \n\none two\n\none two\n\nplain" and got[0].updated is not None
    assert (got[1].title, got[1].source_ref) == ("A-2", "Jira:A-2")
    assert "project+in+%28%22A%22%2C%22B%22%29+AND+updated" in paged.jira_options("http://x", "e", "t", ["A", "B"], "2024-01-01")["list_path"]
    node = {"id": "u1", "identifier": "T-1", "title": "Tit", "description": "d", "state": {"name": "Done"}, "assignee": {"name": "Ann"}, "comments": {"nodes": [{"body": "c"}, {"body": ""}]}, "updatedAt": "2024-01-02T00:00:00Z"}
    one = paged.linear_documents(bodies({"data": {"issues": {"nodes": [node]}}})).first()
    assert (one.external_id, one.author, one.text) == ("T-1", "Ann", "Tit\n\nState: Done\n\nAssignee: Ann\n\nd\n\nc")
    native = "application/vnd.google-apps."
    files = [("1", "a", native + "document"), ("2", "b", native + "folder"), ("3", "c", native + "drawing"), ("4", "d.docx", "application/x"), ("5", "e", "application/zip")]
    plan = {r.external_id: (r.kind, r.export) for r in paged.drive_plan(bodies({"files": [{"id": i, "name": n, "mimeType": m} for i, n, m in files]})).collect()}
    assert plan == {"1": ("txt", "text/plain"), "3": ("pdf", "application/pdf"), "4": ("docx", None), "5": (None, None)}
    boards = bodies({"id": "b1", "name": "Plan", "description": "<p>why</p>", "modifiedAt": "2024-01-02T00:00:00Z"}, {"id": "b2", "name": "", "modifiedAt": "old"}, {"id": "b2", "name": "", "modifiedAt": "old"})
    known = spark.createDataFrame([("b2", "old")], "board_id string, modified_at string")
    assert [r.board_id for r in paged.boards_to_fetch(boards, known).collect()] == ["b1"]
    things = [
        {"id": "f", "type": "frame", "data": {"title": "Do"}, "position": {"x": 0, "y": 5}}, {"id": "n1", "type": "sticky_note", "data": {"content": "<b>first</b> &amp; more"}, "position": {"x": 1, "y": 6}, "parent": {"id": "f"}},
        {"id": "n2", "type": "card", "data": {"title": "top", "description": "low"}, "position": {"x": 1, "y": 9}, "parent": {"id": "f"}}, {"id": "n3", "type": "text", "data": {"content": "loose"}}, {"id": "i", "type": "image"},
    ]
    items = spark.createDataFrame([("b1", json.dumps(t)) for t in things], "board_id string, item string")
    links = spark.createDataFrame([("b1", json.dumps({"startItem": {"id": "n1"}, "endItem": {"id": "n2"}, "captions": [{"content": "then"}]}))], "board_id string, item string")
    doc = paged.board_documents(boards.limit(1), items, links).first()
    assert doc.text == "why\n\n- loose\n\n## Do\n- first & more\n- top — low\n\nLinks:\n- first & more -[then]-> top — low" and doc.external_id == "miro:b1"
    assert boards.select(F.lit(1)).count() == 3

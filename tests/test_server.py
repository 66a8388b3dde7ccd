import io
import json

from keyreel import server


def talk(*messages):
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0", **m}) for m in messages) + "\n"), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def test_protocol():
    start, listed, odd, junk = talk({"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "none"}, "{", "")
    assert start["result"]["serverInfo"]["name"] == "keyreel" and odd["error"]["code"] == -32601 and junk["error"]["code"] == -32700
    tools = {t["name"]: t["inputSchema"] for t in listed["result"]["tools"]}
    assert set(tools) == {"doctor", "probe", "extract", "analyze", "detect", "select", "export", "run", "estimate"}
    assert tools["run"]["required"] == ["inputs", "workspace"] or set(tools["run"]["required"]) == {"inputs", "workspace"}
    assert tools["select"]["properties"]["with"] == {"type": "array", "items": {"type": "string"}} and tools["select"]["properties"]["dedupe"] == {"type": "boolean"}
    assert tools["extract"]["properties"]["from"] == {"type": "number"}


def test_calls():
    say = lambda name, **a: talk({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})[0]["result"]
    assert say("estimate", duration=10, every=0.5)["structuredContent"] == {"frames": 20}
    assert say("estimate")["isError"] and say("estimate")["structuredContent"]["code"] == "USAGE"
    assert say("none")["structuredContent"]["code"] == "USAGE" and say("doctor", x=1)["structuredContent"]["code"] == "USAGE"
    assert say("probe", inputs=["--odd.mp4"])["structuredContent"]["code"] == "NOT_FOUND"
    assert server.argv_of("select", {"frames": "f", "with": ["dog", "cat"], "dedupe": True, "limit": 2, "rank": None}) == ["select", "--with=dog", "--with=cat", "--dedupe", "--limit=2", "--", "f"]

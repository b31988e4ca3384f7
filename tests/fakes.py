"""Services that answer from rules and fail on purpose."""

import threading

from corpusforge.sources.search import Reply

_seen: dict = {}
_lock = threading.Lock()


def shaky(total=10, fail=2, status=503, log=None):
    """Each request fails ``fail`` times; documents are numbered, every third without an abstract."""

    def ask(query, start, rows, sort):
        key = (query, start, rows)
        with _lock:
            _seen[key] = n = _seen.get(key, 0) + 1
        if log:
            with open(log, "a") as f:
                f.write(f"{query}|{start}|{rows}|{n}\n")
        if n <= fail:
            if status == "timeout":
                raise TimeoutError("too slow")
            if status == "down":
                raise ConnectionError("refused")
            return Reply(status, message="not now", wait=0.0)
        _seen.pop(key, None)
        docs = [{"bibcode": f"{query}-{i}", "abstract": None if i % 3 == 0 else "Not Available" if i % 7 == 0 else "x" * (50 if i % 5 == 0 else 200)} for i in range(start, min(total, start + rows))]
        return Reply(200, docs, total)

    return ask


def judge():
    """Answers by what stands in the query."""

    def ask(query, start, rows, sort):
        for word, reply in {"syntax": Reply(400, message="near '('"), "mute": Reply(400), "key": Reply(401), "busy": Reply(429, wait=0.0), "gone": Reply(404), "none": Reply(200, [], 0)}.items():
            if word in query:
                return reply
        if "slow" in query:
            raise TimeoutError("10 s")
        if "cut" in query:
            raise ConnectionError("reset")
        return Reply(200, [{"bibcode": f"{query}{i}"} for i in range(rows)] + [{"title": "no id"}], 7)

    return ask

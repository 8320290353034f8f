import pytest

from webmill.functions import validate as V


def test_validation():
    V.request("https://a.org/x")
    V.job_filter("running", 1, 100)
    with pytest.raises(V.InvalidInput, match="url.*method.*max_retries"):
        V.request("nope", "FETCH", -1)
    with pytest.raises(V.InvalidInput, match="status.*page.*size"):
        V.job_filter("odd", 0, 101)
    assert V.message_of(ValueError("x")) == "x" and V.message_of(None) == "Unknown error"
    V.start_crawl("https://a.org/", None, None)
    with pytest.raises(V.InvalidInput, match="url.*max_pages.*max_depth.*agents.*page_delay_ms.*title"):
        V.start_crawl("ftp:", 0, -1, 21, -1, " ")
    V.job_update("paused")
    for wrong in ({}, {"status": "odd"}, {"title": ""}):
        with pytest.raises(V.InvalidInput):
            V.job_update(**wrong)


def test_errors_of_requests():
    from types import SimpleNamespace as Row

    got = V.failures([Row(url="u", state="failed"), Row(url="v", state="blocked"), Row(url="w", state="completed")])
    assert [type(e) for e in got] == [V.OutOfRetries, V.Disallowed] and got[0].url == "u" and all(isinstance(e, V.WebmillError) for e in got)


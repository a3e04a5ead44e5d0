"""A record service for tests: pages of two, tokens that expire once, days read from a file so that executors see them too."""

import os

STATE = os.environ.get("FAKE_SERVICE_STATE", "/tmp/fake_service_state")
RECORDS = {"2024-01-01": 5, "2024-01-02": 0, "2024-01-03": 3, "2024-01-04": 1}


def today():
    with open(os.path.join(STATE, "today")) as f:
        return f.read().strip()


def record(day, k):
    name = f"<header{' status=\"deleted\"' if k == 1 else ''}><identifier>oai:x:{day}/{k}</identifier><datestamp>{day}</datestamp><setSpec>cs</setSpec></header>"
    body = "" if k == 1 else f"<metadata><arXiv xmlns='http://x/'><id>{day}/{k}</id><license> http://l/{k} </license></arXiv></metadata>"
    return f"<record>{name}{body}</record>"


def fetch(asked):
    if "resumptionToken" in asked:
        day, at = asked["resumptionToken"].split("|")
        mark = os.path.join(STATE, f"expired-{day}")
        if at == "2" and day == "2024-01-01" and not os.path.exists(mark):
            open(mark, "w").close()
            return "<OAI-PMH><error code='badResumptionToken'>expired</error></OAI-PMH>"
    else:
        day, at = asked["from"], "0"
        assert asked["until"] == day and asked["set"] == "cs" and asked["metadataPrefix"] == "arXiv"
    at, n = int(at), RECORDS.get(day, 0)
    if not n:
        return "<OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'><error code='noRecordsMatch'/></OAI-PMH>"
    rows = "".join(record(day, k) for k in range(at, min(n, at + 2)))
    token = f"<resumptionToken cursor='{at}'>{f'{day}|{at + 2}' if at + 2 < n else ''}</resumptionToken>"
    return f"<OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'><ListRecords>{rows}{token}</ListRecords></OAI-PMH>"


def broken(asked):
    return "<OAI-PMH><error code='badArgument'>no</error></OAI-PMH>"

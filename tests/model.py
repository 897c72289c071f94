"""A plain model of the marketplace's semantics, one event after the other, for comparison on small logs."""

import statistics
from collections import defaultdict

TERMINAL = ("JobCompleted", "JobRejected", "Refunded", "JobExpired")


def blocks_of(events):
    by = defaultdict(list)
    for e in sorted(events, key=lambda e: (e["block"], e["log_index"], e["job_id"])):
        by[e["block"]].append(e)
    return sorted(by.items())


def views_of(events):
    """(views, (job, kind, block, log_index) of each job's closing), block by block in three phases."""
    facts, prov, cli, pairs = {}, {}, {}, {}
    views, closed, pending = [], {}, set()
    new_p = lambda: {"funded": 0, "done": 0, "self": 0, "expired": 0, "open": set(), "first": None, "last": None, "amounts": []}
    for block, batch in blocks_of(events):
        for e in batch:
            f = facts.setdefault(e["job_id"], {"client": None, "provider": None, "budgets": 0, "last": None, "funded": False, "expired_at": None, "block": None})
            if e["kind"] == "JobCreated":
                f.update(client=e["client"], provider=e["provider"], expired_at=e["expired_at"], block=block)
                if f["client"]:
                    cli.setdefault(f["client"], {"created": 0, "funded": 0})["created"] += 1
                if f["provider"]:
                    p = prov.setdefault(f["provider"], new_p())
                    p["first"] = p["first"] or block
                    p["last"] = block
            elif e["kind"] == "BudgetSet":
                f["budgets"] += 1
                f["last"] = e["amount"]
        for e in batch:
            f = facts[e["job_id"]]
            if e["kind"] != "JobFunded" or not f["client"] or not f["provider"]:
                continue
            p, c, x = prov[f["provider"]], cli[f["client"]], pairs.get((f["client"], f["provider"]), [0, 0])
            pending.add(e["job_id"])
            views.append(
                (
                    e["job_id"], f["provider"], f["client"], block, e["amount"], f["budgets"], f["expired_at"] - e["ts"], block - f["block"],
                    p["funded"], p["done"], p["self"], p["expired"], statistics.median(p["amounts"]) if p["amounts"] else None,
                    block - p["first"], block - p["last"], len(p["open"]), c["created"], c["funded"], x[0], x[1],
                )
            )
        for e in batch:
            f = facts[e["job_id"]]
            if e["kind"] in TERMINAL and e["job_id"] in pending and e["job_id"] not in closed:
                closed[e["job_id"]] = (e["kind"], block, e["log_index"])
            if not f["client"] or not f["provider"]:
                continue
            p = prov[f["provider"]]
            if e["kind"] == "JobFunded":
                p["funded"] += 1
                cli[f["client"]]["funded"] += 1
                p["open"].add(e["job_id"])
                p["last"] = block
                pairs.setdefault((f["client"], f["provider"]), [0, 0])[0] += 1
                f["funded"], f["last"] = True, e["amount"]
            elif e["kind"] in TERMINAL:
                p["open"].discard(e["job_id"])
                p["last"] = block
                if f["funded"]:
                    if e["kind"] == "JobCompleted":
                        p["done"] += 1
                        pairs[f["client"], f["provider"]][1] += 1
                        if f["last"]:
                            p["amounts"].append(f["last"])
                    elif e["kind"] == "JobExpired":
                        p["expired"] += 1
                    elif e["kind"] == "JobRejected" and e["rejector"] == f["provider"]:
                        p["self"] += 1
    return views, closed


def managed(applications, delta, baseline, trial=10):
    """Status, applications and hits of one rule after a row of outcomes."""
    status, n, hits, recent = "provisional", 0, 0, []
    for completed in applications:
        if status == "demoted":
            break
        right = (delta < 0) != completed
        n, hits = n + 1, hits + right
        recent = (recent + [right])[-trial:]
        if n >= trial:
            chance = 1 - baseline if delta < 0 else baseline
            status = "graduated" if sum(recent) / len(recent) > chance else "demoted"
    return status, n, hits

"""Row-by-row definitions of the features, for small fixtures."""

from math import sqrt


def rolling(rows, what, period, value=None, keys=()):
    out = {}
    for r in rows:
        frame = [x for x in rows if x["customer_id"] == r["customer_id"]
                 and all(x[k] == r[k] for k in keys)
                 and r["event_us"] - period <= x["event_us"] < r["event_us"]]
        if what == "count":
            out[r["event_id"]] = len(frame)
        elif what == "distinct":
            out[r["event_id"]] = len({x[value] for x in frame})
        else:
            present = [x[value] for x in frame if x[value] is not None]
            total = round(sum(present), 4)
            mean = total / len(present) if present else None
            out[r["event_id"]] = total if what == "sum" else mean
    return out


def history(rows, columns):
    out = {}
    for r in rows:
        before = sorted(((x["event_us"], x["event_id"], x) for x in rows
                         if x["customer_id"] == r["customer_id"]
                         and (x["event_us"], x["event_id"]) < (r["event_us"], r["event_id"])),
                        key=lambda x: x[:2])
        before = [x for _, _, x in before]

        def like(c):
            return [x for x in before if x[c] == r[c]]

        def since(prior):
            return (r["event_us"] - prior[-1]["event_us"]) // 1_000_000 if prior else -1

        n, amts = len(before), [x["amt"] or 0.0 for x in before]
        known = r["amt"] is not None
        mean = round(sum(amts), 4) / n if n else 0.0
        var = sum(a * a for a in amts) / n - mean * mean if n else 0.0
        last = before[-1]["amt"] if before else None
        out[r["event_id"]] = {
            "cust_prev_events": n,
            "cust_prev_amt_mean": (mean if known else None) if n else 0.0,
            "cust_prev_amt_std": (sqrt(max(var, 0)) if known else None) if n > 1 else 0.0,
            "sec_since_prev_event": since(before),
            "amt_delta_prev": r["amt"] - (last or 0.0) if known else None,
            "cnt_prev_same_type": len(like(columns.type)),
            "cnt_prev_same_desc": len(like(columns.desc)),
            "cnt_prev_same_mcc": len(like(columns.mcc)),
            "cnt_prev_same_subtype": len(like(columns.subtype)),
            "cnt_prev_same_session": len(like(columns.session)),
            "sec_since_prev_same_type": since(like(columns.type)),
            "sec_since_prev_same_desc": since(like(columns.desc)),
            "events_before_today": len(like(columns.date)),
        }
    return out


def average_precision(pairs):
    positives = sum(y for _, y in pairs)
    total = 0.0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        at = [y for x, y in pairs if x == s]
        above = [y for x, y in pairs if x >= s]
        total += sum(at) * sum(above) / len(above)
    return total / positives if positives else None

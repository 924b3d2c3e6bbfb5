"""A cycle planned with plain loops over dictionaries, to hold the DataFrame program against."""

from collections import Counter, defaultdict

OP = ("stage", "ord", "uid", "op", "on", "winner", "origin", "other_uid", "pass", "relinked", "hash")
CELLS = {
    "unchanged": {"unchanged": None, "same": ("refresh", "right"), "changed": None, "deleted": ("delete", "left")},
    "same": {"unchanged": ("refresh", "left"), "same": ("refresh", "both"), "changed": ("update", "left"), "deleted": ("delete", "left")},
    "changed": {"unchanged": None, "same": ("update", "right"), "changed": ("conflict", None), "deleted": ("resurrect", "right")},
    "deleted": {"unchanged": ("delete", "right"), "same": ("delete", "right"), "changed": ("resurrect", "left"), "deleted": ("forget", None)},
}


def shares(a, b):
    return bool(set(a["tokens"]) & set(b["tokens"]))


def alike(a, b):
    if a["name"] is None or a["name"] != b["name"]:
        return False
    return shares(a, b) or (not a["tokens"] and not b["tokens"] and a["org"] is not None and a["org"] == b["org"])


def loosely(a, b):
    bare = not a["tokens"] and not b["tokens"] and a["org"] is not None and a["org"] == b["org"]
    return (a["name"] is not None and a["name"] == b["name"]) or shares(a, b) or bare


def contested(x, own, other, test):
    mine = [y for y in other if test(x, y)]
    return len(mine) if len(mine) != 1 else sum(test(z, mine[0]) for z in own)


def plan(left, right, state, winner="left"):
    snaps = {"left": left, "right": right}
    ops, skips, diags, held, cards, unsure, fresh = [], [], [], {}, {}, {}, {}
    emit = lambda **x: ops.append({k: x.get(k) for k in OP})
    uids = {r["uid"] for r in state}
    for s, snap in snaps.items():
        at, seen, unsure[s] = {r[f"{s}_href"]: r["uid"] for r in state}, defaultdict(list), False
        for e in snap:
            known = at.get(e["href"])
            if e["kind"] in ("held", "unreadable"):
                if e["kind"] == "unreadable":
                    diags.append((s, "unreadable", None, known, e["href"]))
                if known:
                    held.setdefault(known, "unreadable_or_waiting")
                unsure[s] |= known is None
            elif e["kind"] == "unchanged":
                if known:
                    seen[known].append(e)
                unsure[s] |= known is None
            elif known and known != e["uid"]:
                diags.append((s, "uid_changed", e["uid"], known, e["href"]))
                for u in (known, e["uid"]):
                    held[u] = min(held.get(u, "uid_changed"), "uid_changed")
            else:
                seen[e["uid"]].append(e)
        cards[s] = seen
    holds = set(held)
    for s in snaps:
        own = {u for e in snaps[s] for u in ()}  # noqa: F841
        for u, es in list(cards[s].items()):
            if len(es) > 1:
                diags.append((s, "duplicate_uid", u, None, None))
                held[u] = min(held.get(u, "duplicate_uid"), "duplicate_uid")
    holds = set(held)
    for s in snaps:
        fresh[s] = {u: es[0] for u, es in cards[s].items() if len(es) == 1 and u not in holds}
    for r in sorted(state, key=lambda r: r["id"]):
        if r["uid"] in holds:
            continue
        status, got = {}, {}
        for s in snaps:
            e = got[s] = fresh[s].get(r["uid"])
            status[s] = "deleted" if e is None else "unchanged" if e["kind"] == "unchanged" else "same" if e["hash"] == r["stored_hash"] else "changed"
        cell = CELLS[status["left"]][status["right"]]
        if cell is None:
            if "changed" in status.values():
                diags.append(("left" if status["left"] == "unchanged" else "right", "unread_target", r["uid"], None, None))
            continue
        late = [s for s in snaps if unsure[s] and status[s] == "deleted"]
        if late:
            diags += [(s, "deletion_deferred", r["uid"], None, None) for s in late]
            held[r["uid"]] = "deferred"
            continue
        op, on = cell
        x = {"stage": 0, "ord": r["id"], "uid": r["uid"], "op": op, "on": on}
        if op == "conflict" and got["left"]["hash"] == got["right"]["hash"]:
            x |= {"op": "refresh", "on": "both", "hash": got["left"]["hash"]}
        elif op == "conflict":
            x |= {"on": "right" if winner == "left" else "left", "winner": winner, "origin": "sync", "hash": got[winner]["hash"]}
        elif op in ("update", "resurrect"):
            x["hash"] = got["left" if on == "right" else "right"]["hash"]
        emit(**x, row=r)
    by_id = {r["id"]: r for r in state}
    gone = [o for o in ops if o["op"] == "delete"]
    for o in gone:
        partner = next((p for p in gone if p["on"] != o["on"] and loosely(by_id[o["ord"]], by_id[p["ord"]])), None)
        if partner:
            diags.append((o["on"], "delete_held", o["uid"], partner["uid"], None))
            held[o["uid"]] = "cross_delete"
            o["drop"] = True
    ops[:] = [o for o in ops if not o.pop("drop", False)]

    rest = {s: [e for u, e in sorted(fresh[s].items()) if u not in uids and u not in held] for s in snaps}
    other = {e["uid"]: e for e in rest["right"]}
    for e in [e for e in rest["left"] if e["uid"] in other]:
        same = e["hash"] == other[e["uid"]]["hash"]
        lost = {"on": "right" if winner == "left" else "left", "winner": winner, "origin": "baseline"}
        emit(stage=1, uid=e["uid"], op="adopt" if same else "conflict", hash=e["hash"] if winner == "left" or same else other[e["uid"]]["hash"], **({} if same else lost))
    both = {o["uid"] for o in ops if o["stage"] == 1}
    rest = {s: [e for e in es if e["uid"] not in both] for s, es in rest.items()}
    for stage, test in ((2, lambda a, b: a["content"] is not None and a["content"] == b["content"]), (3, alike)):
        pairs = [(a, b) for a in rest["left"] for b in rest["right"] if test(a, b)]
        nl, nr = Counter(a["uid"] for a, _ in pairs), Counter(b["uid"] for _, b in pairs)
        done = [(a, b) for a, b in pairs if nl[a["uid"]] == nr[b["uid"]] == 1]
        if stage == 2:
            refused = {"left": {a["uid"]: contested(a, rest["left"], rest["right"], test) for a, _ in pairs}, "right": {b["uid"]: contested(b, rest["right"], rest["left"], test) for _, b in pairs}}
        for a, b in done:
            more = {"pass": "content", "hash": a["hash"]} if stage == 2 else {"pass": "identity", "winner": winner, "hash": (a if winner == "left" else b)["hash"]}
            emit(stage=stage, uid=a["uid"], op="recreate", on="right", other_uid=b["uid"], **more)
        rest["left"] = [a for a in rest["left"] if a not in [x for x, _ in done]]
        rest["right"] = [b for b in rest["right"] if b not in [y for _, y in done]]
    aliases = {o["other_uid"]: o["uid"] for o in ops if o["op"] == "recreate"}
    for stage, s, o in ((4, "left", "right"), (5, "right", "left")):
        known = {}
        for e in [e for e in sorted(snaps[o], key=lambda e: e["href"]) if e["kind"] == "fetched" and e["uid"]] + state:
            known.setdefault(e["uid"], e)
        made = []
        for e in rest[s]:
            skip = lambda outcome, n, e=e: skips.append((s, e["uid"], e["href"], outcome, n))
            names = [x for x in rest[o] if x["name"] == e["name"]]
            nameless = lambda a, b: a["name"] is None and b["name"] is None and shares(a, b)
            if e["uid"] in refused[s]:
                skip("ambiguous", refused[s][e["uid"]])
            elif e["name"] is None and any(nameless(e, x) for x in rest[o]):
                skip("ambiguous", contested(e, rest[s], rest[o], nameless))
            elif e["name"] is None and (n := sum(shares(e, k) for k in known.values())):
                skip("likely_duplicate", n)
            elif e["name"] is None or not names:
                made.append(e)
            else:
                skip("ambiguous", contested(e, rest[s], rest[o], alike))
        for e in made:
            n = sum(e["name"] is None and x["name"] is not None and shares(e, x) for x in made)
            relinked = sum(m in aliases for m in e["members"]) if s == "right" else 0
            if n:
                skips.append((s, e["uid"], e["href"], "likely_duplicate", n))
            else:
                emit(stage=stage, uid=e["uid"], op="copy_group" if relinked else "create", on=o, hash=e["hash"], relinked=relinked or None)
    return ops, skips, diags, held

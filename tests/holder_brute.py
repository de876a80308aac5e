"""A replay of a random ledger, call by call, that holder rows are held against."""

import random
from collections import defaultdict
from fractions import Fraction

from tokentide.operators import holder_rows

ZERO, DEAD = "0x" + "0" * 40, "0x" + "0" * 36 + "dead"
MANAGER, FACTORY = "0xManager", "0xFactory"
CALLS = "call_id long, token string, kind string, pool string, pool_id string, curve string, hook string, grad_block long, entry_block long, end_block long, deployer string, launch_age_s long"
TRANSFERS = "token string, sender string, receiver string, value decimal(38,0), block long, idx long, tx string"
LIQUIDITY = "protocol string, venue string, pool_id string, kind string, block long, idx long, tx string"


def ledger(seed):
    rng = random.Random(seed)
    states = {"0xT1": ("v2", "0xPoolA", None, None, None, None), "0xt2": ("v4", None, "ID9", None, "0xHook", None), "0xt3": ("pons", "0xPons", "idP", "0xCurve", None, 60), "0xt4": ("v3", "0xPoolB", None, None, ZERO, None), "0xt5": ("other", "0xp", None, None, None, None)}
    pools = [("0xt2", "ID1 ", 20), ("0xT2", "id2", 55), ("0xt3", "idq", 90), ("0xt2", "", 1)]
    calls, transfers, events, idx = [], [], [], 0
    for t, (kind, pool, pid, curve, hook, grad) in states.items():
        wallets = [f"0xw{k}" for k in range(14)] + ["0xDep"]
        venues = [v for v in (pool, curve, MANAGER) if v]
        big = 10**27 if t == "0xt4" else 1
        opens = 30 if t == "0xt4" else 3  # its pool isn't seen before
        transfers += [(t, ZERO, v, 5000 * big, opens, idx, "mint" + t) for v in venues]
        for block in range(opens + 1, 130):
            for _ in range(rng.randrange(4)):
                idx += 1
                tx = rng.choice([f"Tx{t}{block}a", f"tx{t}{block}b", "", None])
                side = rng.random()
                a, b = rng.choice(venues), rng.choice(wallets)
                if side < 0.35:
                    b, a = a, b
                elif side > 0.85:
                    a, b = rng.choice(wallets), rng.choice([*wallets, DEAD, ZERO, t])
                transfers.append((t, a.upper().replace("0X", "0x") if rng.random() < 0.2 and a not in (ZERO, DEAD) else a, b, rng.choice([0, 1, 2, 5, 9]) * big, block, idx, tx))
                if rng.random() < 0.25:
                    v = rng.choice(venues)
                    v4 = v == MANAGER
                    events.append(("v4" if v4 else "v2", v, rng.choice(["id1", "ID2", "idp", "id9", "idx"]) if v4 else None, rng.choice(["add", "remove", "collect"]), block, idx, tx))
        for k in range(6):
            entry = 20 if k == 0 else rng.choice([rng.randrange(2, 125), 59, 60, 61, None if k == 5 else 90])
            calls.append((len(calls) + 1, t, kind, pool, pid, curve, hook, grad, entry, None if entry is None else entry + rng.choice([5, 24, 24, 60]), rng.choice(["0xDep", "0xdep", None, "0xPoolA"]), 7))
    # enough in the wallets that most histories are complete
    for t in states:
        for w in [f"0xw{k}" for k in range(14)] + ["0xDep"]:
            idx += 1  # one wallet of a token has too little
            transfers.append((t, ZERO, w, (2 if (t, w) == ("0xt3", "0xw3") else 400) * (10**27 if t == "0xt4" else 1), 1, idx, "drop"))
    return calls, transfers, events, pools


def plan(call, transfers, events, pools):
    _, token, kind, pool, pid, curve, hook, grad, entry, end, *_ = call
    low = lambda s: (s or "").strip().lower()
    pool, curve, hook, token = low(pool), low(curve), low(hook), low(token)
    mine = [(low(p), b) for t, p, b in pools if low(t) == token and low(p)]
    graduated = lambda block: grad is not None and grad <= block
    ids_pre = {p for p, b in mine if b <= entry} | ({low(pid)} if graduated(entry) and low(pid) else set())
    ids_all = {p for p, _ in mine} | ({low(pid)} if low(pid) else set())
    seen = any(b <= entry and pool in (low(s), low(r)) for s, r, b in ((x[1], x[2], x[4]) for x in transfers if low(x[0]) == token)) or any(low(e[1]) == pool and e[4] <= entry for e in events)

    def at(block):
        out = []
        for a, k in ((pool, kind), (curve, "pons"), (low(MANAGER) if kind == "v4" or graduated(block) else "", "v4")):
            if a and a != ZERO and a not in [x for x, _ in out]:
                out.append((a, k))
        return out if kind in ("v2", "v3", "v4", "pons") else []

    pre, post = at(entry), at(end)
    if kind in ("v2", "v3") and not seen:
        pre = [v for v in pre if v[0] != pool]
    if (kind == "v4" or graduated(entry)) and not ids_pre:
        pre = [v for v in pre if v[0] != low(MANAGER)]
    ex = lambda venues: {token, ZERO, DEAD, low(MANAGER)} | {v for v, _ in venues} | ({low(FACTORY)} if kind == "pons" or curve else set()) | ({hook} if hook and hook != ZERO else set())
    lp = lambda venues, ids: any(k in ("v2", "v3") or k == "v4" and ids for _, k in venues)
    return {"pre": (pre, ex(pre), ids_pre, lp(pre, ids_pre)), "post": (post, ex(post), ids_all, lp(post, ids_all))}


def replay(call, transfers, events, pools, window=50):
    """Expected pre_ and post_ figures of one call, or None without an entry block."""
    entry, end, deployer = call[8], call[9], (call[10] or "").lower()
    if entry is None:
        return None
    plans = plan(call, transfers, events, pools)
    token = call[1].lower()
    mine = sorted((b, i, s.lower(), r.lower(), int(v), (x or "").lower()) for t, s, r, v, b, i, x in transfers if t.lower() == token)
    out, snipers, early = {}, [], []
    for phase, cut in (("pre", entry), ("post", end)):
        venues, ex, ids, lp = plans[phase]
        names = {v for v, _ in venues}
        minted = burnt = n = 0
        held, bad = defaultdict(int), False
        for b, _, s, r, v, _ in mine:
            if b > cut:
                break
            n += phase == "pre" or b > entry
            if s in (ZERO, DEAD):
                minted += v
            else:
                held[s] -= v
                bad |= held[s] < 0
            if r in (ZERO, DEAD):
                burnt += v
            else:
                held[r] += v
        row = {"incomplete": bad, "transfers": n}
        out |= {f"{phase}_{k}": v for k, v in row.items()}
        if bad:
            continue
        inside = [e for e in events if e[1].lower() in names and e[4] <= cut and (e[0] != "v4" or (e[2] or "").lower() in ids)]
        kinds = defaultdict(set)
        for e in inside:
            if e[6]:
                kinds[e[1].lower(), e[6].lower()].add(e[3])
        gone = {x for (_, x), k in kinds.items() if "remove" in k}
        free = lambda a: a not in names and a not in (ZERO, DEAD) and a not in ex
        trades, away, took = [], False, False
        for b, i, s, r, v, x in mine:
            if b > cut or v <= 0:
                continue
            takes, puts = kinds[s, x] & {"remove", "collect"} if x else set(), "add" in kinds[r, x] if x else False
            if s in names and free(r) and not takes:
                trades.append(("buy", r, v, b, i, x))
            elif free(s) and r in names and not puts:
                trades.append(("sell", s, v, b, i, x))
            late = phase == "pre" or b > entry
            as_lp = (s in names and r not in names and r not in (ZERO, DEAD) and takes) or (s not in names and s not in (ZERO, DEAD) and r in names and puts)
            away |= bool(late and s == deployer and r != deployer and r not in (ZERO, DEAD) and not as_lp)
            took |= bool(late and r == deployer and x in gone)
        circulating = minted - burnt - sum(held[a] for a in ex)
        top = sorted((v for a, v in held.items() if v > 0 and a not in ex), reverse=True)
        share = lambda v: float(Fraction(v, circulating)) if circulating > 0 else None
        shown = [t for t in trades if phase == "pre" or t[3] > entry]
        buys, sells = [t for t in shown if t[0] == "buy"], [t for t in shown if t[0] == "sell"]
        got = sum(t[2] for t in buys)
        row = {"holders": len(top), "top1_share": share(sum(top[:1])), "top5_share": share(sum(top[:5])), "top10_share": share(sum(top[:10])), "deployer_share": share(held[deployer]) if deployer and deployer not in ex else None, "deployer_sold": away if deployer else None}
        row |= {"buyers": len({t[1] for t in buys}), "sellers": len({t[1] for t in sells}), "buys": len(buys), "sells": len(sells), "sell_buy_ratio": sum(t[2] for t in sells) / got if got else None}
        events_here = [e for e in inside if phase == "pre" or e[4] > entry]
        row |= {f"lp_{n}": sum(e[3] == k for e in events_here) if lp else None for k, n in (("add", "adds"), ("remove", "removes"), ("collect", "collects"))} | {"deployer_removed_lp": took if lp and deployer else None}
        hold = lambda ws: share(sum(held[w] for w in ws if held[w] > 0 and w not in ex))
        if phase == "pre":
            firsts = {}
            for _, w, _, b, i, _ in sorted(buys, key=lambda t: t[3:5]):
                firsts.setdefault(w, (b, i))
            first = min(firsts.values())[0] if firsts else None
            snipers = [w for w, (b, _) in firsts.items() if b - first <= window]
            early = [w for w, _ in sorted(firsts.items(), key=lambda x: (x[1], x[0]))][:10]
            in_tx = defaultdict(set)
            for t in buys:
                if t[5]:
                    in_tx[t[5]].add(t[1])
            row |= {"supply": minted - burnt, "circulating": circulating, "launch_age_s": call[11], "lp_applicable": lp, "sniper_window_blocks": window, "lp_removed_before_entry": any(e[3] == "remove" and e[4] < entry for e in inside) if lp else None}
            row |= {"first_buy_block": first, "first_buy_to_entry_blocks": entry - first if firsts else None, "snipers": len(snipers) if firsts else None, "first_block_buyers": sum(b == first for b, _ in firsts.values()) if firsts else None, "max_tx_buyers": max(map(len, in_tx.values()), default=0) if firsts else None}
            row |= {"sniper_held_share": hold(snipers) if firsts else None, "early_buyers": ";".join(early) if firsts else None, "early_buyers_held_share": hold(early) if firsts else None}
        else:
            row |= {"presnipers_held_share": hold(snipers) if early else None, "early_buyers_held_share": hold(early) if early else None}
        out |= {f"{phase}_{k}": v for k, v in row.items()}
    return out


def check(spark, seed, keep):
    calls, transfers, events, pools = ledger(seed)
    table = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema)
    from decimal import Decimal

    moved = table([(*r[:3], Decimal(r[3]), *r[4:]) for r in transfers], TRANSFERS)
    ids = table(pools, "token string, pool_id string, init_block long")
    args = table(calls, CALLS), moved, table(events, LIQUIDITY), ids, MANAGER, FACTORY
    plans = {r["call_id"]: r for r in holder_rows.venue_plan(*args).collect()}
    rows = {r["call_id"]: r.asDict() for r in holder_rows.holder_rows(*args, keep=keep).collect()}
    assert len(rows) == len(calls)
    complete = 0
    for call in calls:
        got, want = rows[call[0]], replay(call, transfers, events, pools)
        if want is None:
            assert all(v is None for k, v in got.items() if k != "call_id")
            continue
        for phase, (venues, ex, ids_, lp) in plan(call, transfers, events, pools).items():
            p = plans[call[0]]
            assert p[f"venues_{phase}"] == [v for v, _ in venues] and set(p[f"excluded_{phase}"]) == ex and p[f"lp_{phase}"] == lp, (call, phase, p, venues, ex, lp)
            assert p["pool_ids_pre" if phase == "pre" else "pool_ids_all"] == sorted(ids_)
        complete += not want["pre_incomplete"]
        for k, v in got.items():
            w = want.get(k) if k != "call_id" else call[0]
            same = v is None if w is None else abs(float(v) - float(w)) <= 1e-9 * max(1, abs(float(w))) if isinstance(w, int | float) and not isinstance(w, bool) else v == w
            assert same, (call, k, v, w)
        assert want.keys() <= got.keys() | {"call_id"}, want.keys() - got.keys()
    assert complete > len(calls) // 3

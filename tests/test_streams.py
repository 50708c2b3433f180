"""Streams over several batches and a restart."""

import random
import uuid

from palimpsest.operators.steps import shared_folder
from palimpsest.streaming import state


def plain(rows):
    out, peers = [], {}
    for peer, place, seq, sent, got, ok in rows:
        cursor, confirmed, applied, hot, streak = peers.get(peer, (-1, 0, 0, False, 0))
        verdict = "drifted" if abs(sent - got) > state.DRIFT else "replayed" if seq <= cursor else "applied"
        if verdict == "applied":
            cursor, applied, confirmed, streak = seq, applied + 1, confirmed + ok, streak + 1 if ok else 0
            hot = not ok or (hot and streak < state.COOL_AFTER)
        peers[peer] = (cursor, confirmed, applied, hot, streak)
        out.append((peer, place, verdict, cursor, round(confirmed / applied, 9) if applied else 0.0, hot))
    return out


def test_peers_keep_their_state_over_batches_and_a_restart(spark):
    r = random.Random(6)
    rows = [(f"p{r.randrange(3)}", i, i + r.randrange(-6, 3), 1000 + i, 1000 + i + r.choice([0, 0, 0, 120, -120, 121, -200]), r.random() < 0.7) for i in range(120)]
    folder = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    schema = "peer string, place long, seq long, sent long, got long, ok boolean"
    add = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/m.parquet")
    for start in (0, 30):
        add(rows[start : start + 30])
    run = lambda: state.finished(state.received(state.source(spark, folder, "m", files_a_batch=1)), "append", f"{folder}/run")
    assert run().count() == 60
    for start in (60, 90):
        add(rows[start : start + 30])
    found = run()
    got = sorted((x.peer, x.place, x.verdict, x.cursor, round(x.trust, 9), x.attention) for x in found.collect())
    assert got == sorted(plain(rows)) and found.select("_batch").distinct().count() == 4
    assert {x[2] for x in got} == {"drifted", "replayed", "applied"}

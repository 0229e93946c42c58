from collections import defaultdict

import pytest

from passagekit.plans import streams
from passagekit.streaming import transitions as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    said = [(1, 0, "First sentence here. It goes on well beyond forty characters, and then it stops."), (1, 1, "First sentence here. But then something else is said."), (1, 2, "an open end that is also longer than forty characters"), (1, 3, "closed now. and open again"), (2, 0, "One."), (2, 1, "One."), (2, 2, None)]
    path = tmp_path_factory.mktemp("turns")
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{path}/conversations.parquet")
    return said, str(path)


def by_session(said):
    out = defaultdict(list)
    for c, t, x in said:
        out[c].append((t, x))
    return out


def test_sentence_buffer_gets_whole_turns(spark, folder):
    said, path = folder
    want = []
    for c, turns in by_session(said).items():
        held = ""
        for _, x in turns:
            held = f"{held} {x or ''}".strip()
            if held and held[-1] in ".!?":
                want.append((c, held, "end"))
                held = ""
        if held:
            want.append((c, held, "forced"))
    assert sorted(map(tuple, streams.sentence_buffer(spark, path).collect())) == sorted(want)


def test_recent_dedup_compares_whole_turns(spark, folder):
    said, path = folder
    want = []
    for c, turns in by_session(said).items():
        machine, state = S.Router(), S.Router().start()
        for t, x in turns:
            state, rows = machine.step(state, {"text": x, "kind": "final"})
            want += [(c, t, r["accepted"], r["reason"]) for r in rows]
    got = sorted(map(tuple, streams.recent_dedup_12(spark, path).collect()))
    assert got == sorted(want)
    assert [r[2] for r in got] == [True, True, True, True, True, False, False]

import random

import numpy as np
import pytest

from tideglass.llm import sentences as S


def units(text):
    return [text[a:b] for a, b in S.units_of([text])[0]]


@pytest.mark.parametrize(
    "expected",
    [
        ["Dr. Osk leads the team and reports to J. R. Quillon.", "They said \"apply now!\" and closed the page."],
        ["She wrote: “We will call you. Please keep Oct. 26 free.”", "The panel met at 3 p.m. on Friday."],
        ["“Can you start before April?” the recruiter asked.", "iOS knowledge is welcome.", "npm scripts are here."],
        ["The queue holds 30 roles… and three look stale.", "Nobody answered...", "Who owns it?!", "Good luck!!!"],
        ["The role, ref. R-72, needs SQL (see sec. 4.67).", "Version v5.26.1 of .NET, e.g. on jobs.x-work.example/p?id=8.5, is out.", "The U.S. team, etc., knows Kotlin vs. Rust."],
        ["The offer came from Acme Corp.", "The contract covers staff in the U.S.", "You own it."],
        ["Im 11. Stock sitzt das Team Nr. 14.", "Die Frist endet am 26. Dezember, z. B. um 9 Uhr!", "„Wann?“, fragte sie.", "Sie schrieb: „Bitte warten. Danke.“", "Ende."],
        ["« Quand êtes-vous libre ? » demanda-t-elle.", "La page ferme à 8 h 30 !", "M. Ildane attend, p. ex. ici."],
        ["她写道：“我们周五联系您。请耐心等待。”", "人事同事问：“你能接受吗？”然后挂断了电话。", "面试分为两轮……最后一轮在线上进行。", "打不开？！", "完。"],
        ["結果は「保留。再確認します。」と記録されました。", "年収は約9.42百万円です。"],
        ["마감일은 2026. 10. 14. 오후 7시입니다.", "\"가능합니까?\"라고 물었습니다.", "끝."],
        ["उन्होंने पूछा, “क्या आप तैयार हैं?” और फ़ोन रख दिया।", "डॉ. ओस्क हैं।", "अंतिम तिथि 9.3.2026 है।"],
        ["سألت الموظفة: «متى؟» ثم أغلقت الخط.", "يقود د. أوسك الفريق منذ 2026.", "هل يمكنك البدء؟"],
    ],
)
def test_scripts(expected):
    assert units(" ".join(expected)) == expected


def test_missing_space_and_no_space():
    assert units("The task.Dr. Osk leads.The end") == ["The task.", "Dr. Osk leads.", "The end"]
    assert units("不需要出差。团队共有14人。") == ["不需要出差。", "团队共有14人。"]


def test_thai_spaces():
    assert units("ตำแหน่งนี้ไม่ต้องเดินทาง ทีมงานของเรา รู้จัก CAN bus เป็นอย่างดี") == ["ตำแหน่งนี้ไม่ต้องเดินทาง", "ทีมงานของเรา", "รู้จัก CAN bus เป็นอย่างดี"]


def test_blocks():
    text = "Heading\r\n\r\n- Keep latency under 3.5 ms. Report weekly.\r\n1) Own it, e.g. triage\r\n\r\nA wrapped\nline. Im\n11. Stock ist\nes.\n\nWas it “not\nclosed? Yes."
    assert units(text) == ["Heading", "- Keep latency under 3.5 ms.", "Report weekly.", "1) Own it, e.g. triage", "A wrapped\nline.", "Im\n11. Stock ist\nes.", "Was it “not\nclosed?", "Yes."]


def test_nothing():
    assert S.units_of([None, "", " \n\t ", "\xa0"]) == [[], [], [], []]


def test_every_character_once():
    rnd = random.Random(4)
    alphabet = "aB .!?…\n\"“”„«»「」()-•1。？กข中é\t "
    for _ in range(500):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 120)))
        found = S.units_of([text])[0]
        assert "".join("".join(text[a:b] for a, b in found).split()) == "".join(text.split())
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


def test_parallel_scan_equals_sequential_run():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 64, 65, 1000):
        tape = rnd.integers(0, S.SYMBOLS, size=n).astype(np.int8)
        state, expected = S.OUT, []
        for x in tape:
            expected.append(bool(S.EMIT[state, x]))
            state = S.STEP[state, x]
        for block in (1, 7, 64, 4096):
            assert S.run_transducer(tape, block).tolist() == expected


def test_very_long_text():
    text = "One sentence here. " * 60_000
    assert len(S.units_of([text])[0]) == 60_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "Aa bb. Cc dd.", 0), (1, "Aa bb. Cc dd.", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, start_char int")
    assert sorted((r.doc_id, r.start_char, r.end_char) for r in S.split(df.drop("start_char")).collect()) == [(1, 0, 6), (1, 0, 6), (1, 7, 13), (1, 7, 13)]

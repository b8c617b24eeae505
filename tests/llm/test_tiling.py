import random
import time

import pytest

from pathloom.llm.broken_pairs import NO_PATH, LanguageModel, SuffixAutomaton, classify, tiled_share


def plain_share(answer, question, least=3):
    """Longest free common run first, by trying all of them."""
    free = [True] * len(answer)
    runs = {tuple(question[i:j]) for i in range(len(question)) for j in range(i + least, len(question) + 1)}
    while True:
        best = max(
            ((n, -i) for i in range(len(answer)) for n in range(least, len(answer) - i + 1) if all(free[i : i + n]) and tuple(answer[i : i + n]) in runs),
            default=None,
        )
        if best is None:
            return free.count(False) / len(answer)
        n, i = best[0], -best[1]
        free[i : i + n] = [False] * n


@pytest.mark.parametrize("seed", range(150))
def test_tiling_equals_trying_all_runs(seed):
    rnd = random.Random(seed)
    words = "abcd"[: rnd.randint(1, 4)]
    answer = [rnd.choice(words + "x") for _ in range(rnd.randint(1, 22))]
    question = [rnd.choice(words) for _ in range(rnd.randint(1, 14))]
    assert tiled_share(answer, question) == pytest.approx(plain_share(answer, question))


@pytest.mark.parametrize("seed", range(30))
def test_matches_are_all_maximal_runs(seed):
    rnd = random.Random(seed)
    text = [rnd.choice("abc") for _ in range(rnd.randint(0, 20))]
    asked = [rnd.choice("abc") for _ in range(rnd.randint(0, 20))]
    runs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    got = SuffixAutomaton(text).matches(asked, 1)
    longest = [max(n for n in range(e + 1) if tuple(asked[e - n : e]) in runs) for e in range(len(asked) + 1)]
    last = lambda e: e == len(asked) or longest[e + 1] <= longest[e]
    assert sorted(got) == sorted((n, e - n) for e, n in enumerate(longest) if n and last(e))


def test_a_generation_loop_does_not_hold_up_a_task():
    question = [f"w{i % 40}" for i in range(45)]
    for answer, asked in ((question * 2300, question), (["a", "b"] * 50_000, ["a", "b"] * 30_000)):
        began = time.perf_counter()
        assert tiled_share(answer, asked) == 1.0
        assert time.perf_counter() - began < 1.0


@pytest.mark.parametrize("text", ["Yes, they match.", "Sure, here is the answer", "They carry the same meaning!"])
def test_an_answer_without_a_path_is_no_refusal_unless_it_refuses(text):
    assert classify("Attribute 1 a", text, LanguageModel([])) == NO_PATH


@pytest.mark.parametrize("text, defect", [("clinic ke", "truncated"), ("clinic key (Q1), refers", "truncated"), ("I cannot answer this.", "refusal")])
def test_begun_paths_and_refusals(text, defect):
    assert classify("Attribute 1 a", text, LanguageModel([])) == defect

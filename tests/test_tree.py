from __future__ import annotations

import pytest

from cuesift.config import PRESETS, Settings, SignalRules, embedding_preset, list_embedding_presets, preset
from cuesift.plans import parsing
from cuesift.plans.tree import Node, TreeError, explain, leaves_by_expert, prune, repair, simplified

L = Node.leaf
A, B, C = L("CLIP", "a"), L("OVD", "b"), L("CLIP", "c")


def test_leaves_are_numbered_left_to_right_without_inner_nodes():
    tree = Node.of("AND", A, Node.of("OR", B, C))
    assert [(x.node_id, x.query, x.depth, x.path) for x in tree.leaves()] == [(0, "a", 1, "0.0"), (1, "b", 2, "0.1.0"), (2, "c", 2, "0.1.1")]
    assert leaves_by_expert(tree) == {"CLIP": [(0, "a"), (2, "c")], "OVD": [(1, "b")]}
    assert tree.height() == 2


@pytest.mark.parametrize(
    "bad",
    [
        {"op": "XOR", "children": []},
        {"op": "LEAF", "expert": "CLIP"},
        {"op": "LEAF", "expert": "EYE", "query": "x"},
        {"op": "LEAF", "expert": "CLIP", "query": "x", "children": [A.to_dict()]},
        {"op": "AND", "children": []},
        {"op": "SEQ", "children": [A.to_dict()]},
        {"op": "RIGHT_AFTER", "children": [A.to_dict()] * 3},
        [],
    ],
)
def test_invalid_trees_fail(bad):
    with pytest.raises(TreeError):
        Node.from_dict(bad)


def test_json_round_trip():
    tree = Node.of("RIGHT_AFTER", A, Node.of("SEQ", B, C))
    assert Node.from_json(tree.to_json()) == tree
    with pytest.raises(TreeError):
        Node.from_json("{")


def test_repair_nests_to_the_right_and_leaves_its_input():
    data = {"op": "RIGHT_AFTER", "children": [A.to_dict(), B.to_dict(), C.to_dict(), A.to_dict()]}
    fixed = Node.from_dict(repair(data))
    assert fixed == Node.of("RIGHT_AFTER", A, Node.of("RIGHT_AFTER", B, Node.of("RIGHT_AFTER", C, A)))
    assert len(data["children"]) == 4
    assert repair("x") == "x"


def test_prune_and_simplify():
    tree = Node.of("AND", A, Node.of("AND", B, L("ASR", "hello")))
    assert prune(tree, {"CLIP", "OVD"}) == Node.of("AND", A, B)
    assert prune(L("ASR", "x"), {"CLIP"}) is None
    assert simplified(tree) == Node.of("AND", A, B, L("ASR", "hello"))
    assert simplified(tree, "geometric_mean") == tree
    assert simplified(Node.of("OR", Node.of("AND", A))) == A


def test_explain():
    assert explain(Node.of("AND", A, Node.of("OR", B, C))).splitlines() == ["AND", '├── CLIP("a")', "└── OR", '    ├── OVD("b")', '    └── CLIP("c")']


def test_presets():
    assert preset("fast").enabled("OCR") and not preset("fast").enabled("OVD")
    assert not preset("fast").signals.widths and preset("default").signals.widths
    assert preset("visual_only").experts == ("OVD", "CLIP", "OCR")
    assert preset("additive").tree.join == "additive"
    assert set(PRESETS) == {"default", "visual_only", "fast", "no_smoothing", "additive"}
    with pytest.raises(ValueError):
        preset("nope")
    assert not Settings().enabled("EYE") and Settings().enabled("clip")


def test_smoothing_config_and_embedding_presets():
    s = SignalRules()
    assert (s.width_of("CLIP"), s.width_of("ASR"), s.width_of("CLAP"), s.width_of("?")) == (0.5, 1.5, 2.0, 0.5)
    assert s.with_width("audio", 3.0).width("audio") == 3.0 and s.width("audio") == 2.0
    with pytest.raises(ValueError):
        s.width("smell")
    assert embedding_preset("dfn5b-clip").dim == 1024 and len(list_embedding_presets()) == 5
    with pytest.raises(ValueError):
        embedding_preset("nope")


def test_answers_of_models():
    text = '<think>{"no": 1}</think>Sure:\n```json\n{"op": "RIGHT_AFTER", "children": [%s, %s, %s]}\n```' % tuple(x.to_json() for x in (A, B, C))
    assert parsing.parse_answer(text) == Node.of("RIGHT_AFTER", A, Node.of("RIGHT_AFTER", B, C))
    assert parsing.extract_json('x {"a": "}"} y') == {"a": "}"}
    with pytest.raises(TreeError):
        parsing.extract_json("nothing")
    assert parsing.ModelParser(lambda s, q, t: A.to_json()).parse("?") == A
    with pytest.raises(RuntimeError):
        parsing.ModelParser(lambda s, q, t: 1 / 0).parse("?")


def test_chat_models_fall_back_and_are_asked_again():
    from types import SimpleNamespace as S

    asked = []

    def create(model, messages, temperature, **extra):
        asked.append((len(messages), "response_format" in extra, extra.get("seed")))
        if "response_format" in extra:
            raise ValueError("no JSON mode")
        text = "sorry" if len(messages) == 2 else A.to_json()
        return S(choices=[S(message=S(content=text))])

    client = S(chat=S(completions=S(create=create)))
    assert parsing.create_parser("chat", parsing.remote_chat(client, "m", 7)).parse("?") == A
    assert asked == [(2, True, 7), (2, False, 7), (4, True, 7), (4, False, 7)]
    local = parsing.local_chat(lambda prompt, t: A.to_json() if prompt.startswith("system: ") and prompt.endswith("assistant:") else "")
    assert parsing.ChatParser(local).parse("?") == A
    with pytest.raises(RuntimeError, match="JSON mode"):
        parsing.ChatParser(lambda m, t, j: 1 / 0).parse("?")
    with pytest.raises(TreeError):
        parsing.ChatParser(lambda m, t, j: "never").parse("?")


def test_prompts_follow_the_experts():
    assert parsing.audio_flags(None) == (True, True) and parsing.audio_flags({"ASR": False}) == (False, True)
    assert parsing.allowed_experts(False, False) == ["OCR", "OVD", "CLIP"]
    assert "ASR" not in parsing.system_prompt(asr=False) and "ASR" in parsing.system_prompt()
    for asr in (True, False):
        for _, tree in parsing.example_trees(asr, not asr):
            tree.validate()
    assert parsing.format_question("Q", ["a", "é"]) == 'Q Options: ["a", "\\u00e9"]' and parsing.format_question("Q", []) == "Q"


def test_rule_parser_and_registry():
    p = parsing.create_parser("RULE")
    assert p.parse("red car or dog?") == Node.of("OR", L("OVD", "red car"), L("OVD", "dog"))
    assert p.parse("a man opens the door then the dog barks loudly").op == "SEQ"
    assert p.parse("the dog jumps high right after the man enters").op == "RIGHT_AFTER"
    assert p.parse('the host says "welcome"') == L("ASR", "welcome")
    assert p.parse('a sign with "EXIT"') == L("OCR", "EXIT")
    assert parsing.create_parser("static", A).parse("x") == A
    with pytest.raises(ValueError):
        parsing.create_parser("nope")

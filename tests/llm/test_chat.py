import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import chat, queries, templates
from tidewatch.llm.templates import TemplateError, compile_template

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, spans int, turns int, loss string"
NASTY = st.text(st.sampled_from(["<", "s", ">", "/", "[", "]", "\\", "INST", "TURN", "TEXT", "REPLY", "<s>", "</s>", "[INST]", "[/INST]", "é", "\U0001f600", "\n", " "]).map(str), max_size=12) | st.text(max_size=20)


def render(source, **values):
    return compile_template(source)(values)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[TEXT]", "a\\"]), st.lists(st.sampled_from(["<", "s>", "/", "[INST]", "[", "INST]", "\\", "</s>", "é\U0001f600", "\n", "[/TURN]"]), max_size=8).map("".join)), max_size=6))
def test_round_trip_and_mask(turns):
    text, spans = chat.renderer(chat.TEMPLATE, chat.CONTROLS)({"turns": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_turns(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_any_text_comes_back(text):
    assert chat.unescape(chat.escape(text)) == text


def test_language():
    assert render("{% for a in l if a > 1 %}{{ loop.index }}{{ a }}{{ ',' if not loop.last }}{% else %}-{% endfor %}", l=[1, 2, 3])[0] == "12,23"
    assert render("{% for a in l %}{% else %}none{% endfor %}", l=[])[0] == "none"
    assert render("{% if a %}A{% elif b == 2 %}B{% else %}C{% endif %}", a=0, b=2)[0] == "B"
    assert render("{% set x = 1 %}{% for a in l %}{% set x = x + a %}{{ x }} {% endfor %}{{ x }}", l=[1, 2])[0] == "2 3 1"
    assert render("a  {{- ' b ' | trim -}}  c {# no #}d")[0] == "abc d"
    assert render("{{ x is defined }}{{ x | default('q') }}{{ m.k[0] }}{{ m['z'] }}{{ 'a' in m.s and 'z' not in m.s }}", m={"k": ["v"], "s": "abc"})[0] == "falseqvtrue"
    assert render("{{ 2 + 3 * 4 // 5 - -1 }}{{ 'x' ~ 1 ~ none }}{{ [1, 'a'] | join('/') }}{{ '}}' }}{{ l | length }}", l=[1])[0] == "5x1none1/a}}1"
    assert render("a{% generation %}b{% if x %}cc{% endif %}{% endgeneration %}d{% generation %}{{ y }}{% endgeneration %}", x=1, y="") == ("abccd", [(1, 4)])


def test_constants_are_folded():
    def tree(source):
        return templates.fold(templates.parse(source))

    assert tree("a{{ 'b' ~ 1 + 1 }}{% if 1 < 2 %}c{% else %}{{ q }}{% endif %}{% for x in [] %}{{ x }}{% else %}d{% endfor %}{% generation %}{% endgeneration %}") == (templates.Text("ab2cd"),)
    assert tree("{{ x and 1 == 2 }}{{ 1 == 2 and x }}{{ 'A' | lower if true else y }}") == (
        templates.Emit(templates.Either(False, templates.Name("x"), templates.Const(False))), templates.Text("falsea"))
    assert tree("{{ 1 / 0 }}") == (templates.Emit(templates.Apply("operator", "/", (templates.Const(1), templates.Const(0)))),)
    assert render("{% if x %}{{ 1 / 0 }}{% endif %}ok")[0] == "ok"


@pytest.mark.parametrize("source", [
    "{{ a.__class__ }}", "{{ _a }}", "{{ f() }}", "{{ a.b.c }}", "{{ t.upper }}", "{{ 'a' * 9 }}", "{{ 1 / 0 }}", "{{ x | nope }}", "{{ l }}", "{{ 1 +", "{{ }}", "{{ 1 2 }}", "{% if a %}", "{% endif %}",
    "{% for a in 'abc' %}{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ raise_exception('stop') }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}",
    "{% if 1 %}" * 99 + "{% endif %}" * 99, "{{ 'a' < 1 }}", "{{ 'open }}"])
def test_faults_and_what_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        render(source, a={}, t="text", l=[1])


def test_long_output_raises_instead_of_being_cut():
    run = compile_template("{% for a in l %}{% for b in l %}{{ a }}{% endfor %}{% endfor %}", limit=50)
    assert run({"l": ["x"] * 7})[0] == "x" * 49
    with pytest.raises(TemplateError):
        run({"l": ["x"] * 8})


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 1, "assistant", "b <s>"), (1, 0, "user", "[INST] a"), (2, None, None, None), (2, 0, "assistant", None), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "assistant", "tie"), (None, 0, "user", "no id"),
            (4, None, "tool[TEXT]", "\\\\<\\/s>"), (5, 0, "assistant", "w " * 400_000 + "\U0001f600"), (5, 7, "user", ""), (5, 9, "assistant", "\n[/TURN]")]
    rows += [(6, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(3000)]
    spark.createDataFrame([(*r, "f", 1, 2, "l") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_chat_formatting(spark, str(tmp_path)).collect()
    odd = [(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(rows + odd)
    one = next(r for r in got if r.conv_id == -1)
    assert one.formatted_chars == len("<s>[INST]<\\/s>[\\INST] ok [\\/INST][/INST][REPLY]<\\/s>[\\INST] ok [\\/INST]</s>")


def test_other_templates_and_values(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id bigint, turn bigint, role string, text string")
    source = "{{ title }}:{% for t in turns %}{% if t.role == who %}{% generation %}{{ t.text | upper }}{% endgeneration %}{% else %}{{ t.text }}{% endif %};{% endfor %}"
    (r,) = chat.formatted(rows, template=source, values={"title": "T", "who": "assistant"}).collect()
    assert (r.formatted, [tuple(s) for s in r.spans]) == ("T:hi;YO;", [(5, 7)])
    with pytest.raises(TemplateError):
        chat.formatted(rows, template="{% if %}")


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.formatted(empty)).count() == 0
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in queries.op12_chat_formatting(spark, str(tmp_path)).collect()] == [-1]


def test_what_is_no_turn_is_not_read():
    with pytest.raises(ValueError):
        chat.read_turns("<s>[INST]a[/INST]loose")

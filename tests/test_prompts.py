import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import prompts as P

LABELS = ["FCD", "No FCD"]
EXAMPLES = "array<struct<label_code:bigint,k:bigint,example:string,label_text:string>>"
HEAD = (
    "Your task is to categorize texts in the following categories:\n\nFCD\nNo FCD\n\n"
    'You will only respond with the category. Do not include the word "Category".'
    " Do not provide explanations or notes."
)


@pytest.fixture
def row(make):
    return make([("q1\nq2", [(0, 0, "a\nb", "FCD"), (1, 0, "c", "No FCD")])], f"text string, examples {EXAMPLES}")


def build(df, builder, examples=True):
    shots = F.col("examples") if examples else F.lit(None).cast(EXAMPLES)
    return df.select(builder(F.col("text"), LABELS, shots)).first()[0]


def test_inst(row):
    role = "<s>[INST]You are an experienced radiologist that help users extract infromation from radiology reports. "
    assert build(row, P.prompt_inst) == (
        role + HEAD + "\nCategorize the text: a b\n[/INST]FCD</s>"
        "[INST]\nCategorize the text: c\n[/INST]No FCD</s>[INST]\nCategorize the text: q1\nq2\n[/INST]"
    )
    assert build(row, P.prompt_inst, False) == role + HEAD + "[/INST][INST]\nCategorize the text: q1\nq2\n[/INST]"


def test_im(row):
    got = build(row, P.prompt_im)
    assert got.startswith("<|im_start|> system\nYou are an experienced radiologist that help users extract information")
    assert got.endswith(
        HEAD + "<|im_end|>\n<|im_start|> question\nCategorize the text: a b\n<|im_end|>\n<|im_start|> answer\nFCD<|im_end|>"
        "\n<|im_start|> question\nCategorize the text: c\n<|im_end|>\n<|im_start|> answer\nNo FCD<|im_end|>"
        "\n<|im_start|> question\nCategorize the text: q1\nq2\n<|im_end|>\n<|im_start|> answer\n"
    )
    assert build(row, P.prompt_im, False).endswith(
        "<|im_end|>\n<|im_start|> question\nCategorize the text: q1\nq2\n<|im_end|>\n<|im_start|> answer\n"
    )


def test_inquiry(row):
    got = build(row, P.prompt_inquiry)
    assert "Categorize the text in <<<>>> into one of the following predefined categories:\n\nFCD\nNo FCD\n\nYou" in got
    assert got.endswith(
        "notes.\n\n####\nHere are some examples:\n\nInquiry: a b\nCategory: FCD\nInquiry: c\nCategory: No FCD\n###\n\n"
        "<<<\nInquiry: q1\nq2\n>>>"
    )
    assert build(row, P.prompt_inquiry, False).endswith("notes.<<<\nInquiry: q1\nq2\n>>>")


def test_inquiry_in_danish(row):
    got = build(row, P.prompt_inquiry_da)
    assert got.startswith("Du er en erfaren radiolog, der hjælper brugere") and "i en af ​​følgende" in got
    assert got.endswith(
        "noter.\n\n####\nHer er nogle eksempler:\n\nForespørgsel: a b\nKategori: FCD\nForespørgsel: c\nKategori: No FCD\n"
        "###\n\n<<<\nForespørgsel: q1\nq2\n>>>"
    )


def test_messages(row):
    got = build(row, P.prompt_messages)
    assert [m.role for m in got] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert [m.content for m in got[1:]] == [
        "Categorize the text: a b", "FCD", "Categorize the text: c", "No FCD", "Categorize the text: q1\nq2",
    ]
    assert got[0].content.endswith(HEAD)
    assert [m.role for m in build(row, P.prompt_messages, False)] == ["system", "user"]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_answers(spark):
    assert one(spark, X.parse_suffix(F.lit("ab\n"), F.lit("ab\n cd"))) == " cd"
    mark = ">>>\nCategory: "
    cases = {
        mark + "FCD\nmore": "FCD",
        mark + "\n": "",
        mark + "no end": None,
        "x" + mark + "first\n" + mark + "second\n": "first",
        mark + "a\rb\n": "a\rb",
        "nothing": None,
    }
    for generated, label in cases.items():
        assert one(spark, X.parse_category(F.lit(generated))) == label
    messages = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(content).alias("content"))
        for role, content in (("user", "q"), ("assistant", "a"))
    ])
    assert one(spark, X.parse_last_message(messages)) == "a"


def test_instruction_sentence():
    assert X.category_sentence(["a", "b", "c"]) == "a, b or c"
    assert X.instruction(["a", "b"]) == (
        "Instruct: Classify the medical text describing focal cortical dysplasia (i.e., FCD) as either a or b\nQuery: "
    )
    assert X.instruction(["a", "b"], task="") == ""


def test_small_text_functions(spark):
    assert one(spark, X.norm_quotes(F.lit('say "x"'))) == "say 'x'"
    assert one(spark, X.flatten_newlines(F.lit("a\nb\n"))) == "a b "
    assert one(spark, X.base_name(F.lit("/m/n/model"))) == "model"
    assert one(spark, X.scientific(F.lit(0.000123))) == "1.23e-04"
    pieces = F.array(*[F.lit(t) for t in ("un", "##do", "#x", "##", "y")])
    assert one(spark, X.strip_wordpiece(pieces)) == ["un", "do", "#x", "", "y"]
    assert one(spark, X.strip_wordpiece(pieces, 2)) == ["un", "do"]

"""Prompt and chat-format texts as Column -> Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamhis import profiles as P
from tamhis.functions.text import strip

# The ChatML turn marks.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
ASSISTANT_TURN = f"{TURN_START}assistant\n"


def _text(c) -> Column:
    return F.coalesce(c, F.lit(""))


def turn(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), content, F.lit(TURN_END))


def chatml(instruction: Column, input_: Column, output: Column, system: str = P.SYSTEM_PROMPT) -> Column:
    """system / user / assistant record; the input goes on a line of its own if there is one."""
    user = F.concat_ws("\n", strip(_text(instruction)), F.nullif(strip(_text(input_)), F.lit("")))
    return F.concat_ws(
        "\n", turn("system", F.lit(system)), turn("user", user), turn("assistant", strip(_text(output)))
    )


def template_prompt(instruction: Column, output: Column, head: str = P.TEMPLATE_HEAD,
                    middle: str = P.TEMPLATE_MIDDLE, end: str = P.END_OF_TEXT) -> Column:
    return F.concat(F.lit(head), instruction, F.lit(middle), output, F.lit(end))


def document_text(instruction: Column, input_: Column, output: Column) -> Column:
    """Text of a retrieval document; null if the question or the answer is blank."""
    question = strip(F.concat(_text(instruction), F.lit(" "), _text(input_)))
    answer = strip(_text(output))
    return F.when(
        (question != "") & (answer != ""),
        F.concat(F.lit(P.DOCUMENT_QUESTION), question, F.lit(P.DOCUMENT_ANSWER), answer),
    )


def system_content(use_rag: bool, system: str = P.SYSTEM_PROMPT) -> str:
    return f"{system}\n{P.RAG_INSTRUCTION}" if use_rag else system


def user_content(question: Column, context: Column | None) -> Column:
    if context is None:
        return question
    return F.concat(
        F.lit(f"{P.REFERENCE_HEADER}\n"), _text(context),
        F.lit(f"\n\n{P.QUESTION_HEADER}\n"), question,
    )


def prompt_messages(question: Column, context: Column | None = None, system: str = P.SYSTEM_PROMPT) -> Column:
    """Message list of a request: with a context the retrieval prompt, without it the plain one."""
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(system_content(context is not None, system))),
        message("user", user_content(question, context)),
    )


def render_messages(messages: Column, generation_prompt: bool = True) -> Column:
    """Chat text of an array of (role, content) structs."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(turn(m["role"], m["content"]), F.lit("\n"))), "")
    return F.concat(body, F.lit(ASSISTANT_TURN)) if generation_prompt else body


def panel_prompt(question: Column) -> Column:
    """Chat text of a panel question: the template with the question filled in, then the question itself."""
    system = F.concat(F.lit(P.PANEL_HEAD), question, F.lit(P.PANEL_TAIL))
    return F.concat(turn("system", system), F.lit("\n"), turn("user", question), F.lit("\n" + ASSISTANT_TURN))

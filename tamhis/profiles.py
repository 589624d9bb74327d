"""Language profiles: everything about the text rules that depends on the language of the corpus."""

from dataclasses import dataclass


@dataclass(frozen=True)
class LanguageProfile:
    """Word lists and character folds; all text functions take one as a parameter.

    ``general``/``personal`` are substrings looked for in the normalised question, so write them
    in folded form. ``signatures`` are the literal line beginnings that start a signature block.
    """

    name: str
    general: tuple[str, ...]
    personal: tuple[str, ...]
    signatures: tuple[str, ...]
    fold_from: str = ""
    fold_to: str = ""
    strip_marks: str = ""  # a regex character class, e.g. "[\\u064B-\\u0652]"

    def __post_init__(self):
        if len(self.fold_from) != len(self.fold_to):
            raise ValueError("fold_from and fold_to must have the same length")
        for word in (*self.general, *self.personal, *self.signatures):
            if not word or word != word.strip():
                raise ValueError(f"keywords and signatures must be non-blank and stripped: {word!r}")


# Keyword lists, signature line beginnings, letter folds and mark range of the
# Arabic profile. They decide which rows are kept, so they must stay exactly as they are.
ARABIC = LanguageProfile(
    name="arabic",
    personal=(
        "اعاني", "عمري", "وزني", "دكتور", "ابني", "بنتي", "ابنتي",
        "طولي", "عمليه", "حامل", "السن", "سني", "زوجي", "زوجتي",
        "اخي", "اختي", "والدي", "والدتي", "امي", "ابي", "طفلي", "طفلتي",
    ),
    general=(
        "ما هي", "كيف", "اسباب", "اعراض", "علاج", "طرق", "هل",
        "الفرق", "ما هو", "متي", "لماذا", "ماذا",
    ),
    signatures=("د.", "طاقم الطبي", "الصيدلان", "المصدر"),
    fold_from="أإآةى",
    fold_to="اااهي",
    strip_marks="[\\u064B-\\u0652]",
)

#: Profile for corpora in Latin script, used with the supplied test tables.
LATIN = LanguageProfile(
    name="latin",
    general=("the", "que", "der", "ein"),
    personal=("ich", "les", "worthless"),
    signatures=("Dr.", "Source:"),
    fold_from="éèêà",
    fold_to="eeea",
)


# Prompt and answer texts. They are part of the produced records.
SYSTEM_PROMPT = (
    "أنت مساعد طبي ذكي وموثوق. تقدم معلومات وإرشادات طبية عامة باللغة العربية السليمة، "
    "وتوجه المريض دائماً لاستشارة الطبيب في الحالات الحرجة. "
    "لا تقم بوصف جرعات محددة."
)
RAG_INSTRUCTION = (
    "اعتمد على \"المعلومات المرجعية\" المرفقة عند الإجابة، ولا تذكر معلومات غير موجودة فيها إذا لم تكن متأكداً. "
    "أجب باللغة العربية فقط وبنقاط واضحة ومنسقة."
)
REFERENCE_HEADER = "المعلومات المرجعية:"
QUESTION_HEADER = "سؤال المريض:"
DISCLAIMER = "هذه معلومات عامة للتثقيف الصحي وليست تشخيصاً أو بديلاً عن استشارة الطبيب."
TEMPLATE_HEAD = (
    "أنت مساعد طبي ذكي وموثوق باللغة العربية. دورك الأساسي هو تقديم معلومات طبية عامة، وتثقيف صحي "
    "بأسلوب علمي، دقيق، ومبسط.\n"
    "أجب على السؤال الطبي التالي بدقة:\n"
    "\n"
    "### السؤال:\n"
)
TEMPLATE_MIDDLE = "\n\n### الإجابة:\n"
PANEL_HEAD = (
    "أنت مساعد طبي ذكي وموثوق باللغة العربية. دورك الأساسي هو تقديم معلومات طبية عامة، وتثقيف صحي "
    "بأسلوب علمي، دقيق، ومبسط.\n"
    "يجب أن تكون إجابتك مفصلة، ومنسقة في نقاط مرتبة (Bullet points) لتسهيل القراءة.\n"
    "أجب على السؤال الطبي التالي بدقة:\n"
    "\n"
    "### السؤال:\n"
)
PANEL_TAIL = "\n\n### الإجابة:\n"
END_OF_TEXT = "<|im_end|>"
REPORT_QUESTION = "السؤال: "
REPORT_ANSWER = "الجواب: "
DOCUMENT_QUESTION = "medical question: "
DOCUMENT_ANSWER = "\n medical answer: "
EMPTY_MESSAGE = "Message is empty."

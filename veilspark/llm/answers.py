"""Problem 3: broken prompt and response pairs.

Each answer is looked at for one defect, in this order:
* empty: null, or nothing said: blanks, invisible characters, bare marks, an empty fence or a stand-in for nothing;
* copy: greedy string tiling of question and answer; the answer is a copy if tiles cover all of the question and leave next to nothing of the answer;
* refusal: a clause in which the answerer denies being able, allowed or willing, or declines (the grammars below, in any of the twelve languages), and nothing said besides it but courtesies;
* wrong_language: question and answer are written in different scripts, or string-kernel scores tell their languages apart, both clearly;
* truncated: a pushdown parser over fences, brackets, quotations, lists and emphasis is left with something open, the last line breaks off without an end, or a list's last item
  breaks off: it is a mere beginning of an item that is common in the answers, or breaks off inside a word of one that more answers have than it.

A complete list needs no final mark, nor does a closing mark or emoji after a complete sentence count against it. Trailing references to placeholders are set aside.

Null questions: only defects of the answer alone are looked for. Rows repeated under one id count once (the first by delivery). Empty tables give no rows; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread
from .language import LEAST_CONFIDENCE, SHARPNESS, _usable, scores

DEFECTS = ("empty", "copy", "refusal", "wrong_language", "truncated")

#: Stand-ins for nothing.
STAND_INS = {"none", "null", "nil", "n/a", "na", "nan", "empty", "no answer", "undefined", "tbd", "keine", "leer", "vide", "vacío", "нет", "无", "なし", "blank", "missing", "not available", "no response", "no content", "void", "#n/a"}

#: Refusal grammars. A clause of the answerer (SELF) denies ability, permission or will as to the task, or declines it; a rule forbids it to the answerer; or the passive of these.
_SELF = r"\b(?:i|we|me|us|my|our|this assistant)\b"
_NOT = r"\b(?:can(?:no|['’])?t|cannot|can not|could(?: not|n['’]t)|won['’]t|will not|would(?: not|n['’]t)|(?:am|are|be|['’]m|['’]re) (?:not|unable)|aren['’]t|not (?:able|allowed|permitted|authori[sz]ed|going|comfortable|something|in a position|at liberty)|unable|must(?: not|n['’]t)|may not|should(?: not|n['’]t)|do(?: not|n['’]t)|rather not)\b"
_TASK = r"\b(?:help|assist|answer|provide|discuss|share|summari[sz]e|comply|comment|disclose|support|do|say|give|respond|reply|fulfil|process|engage|speak|talk|go into|take on|weigh in|let|allow|permit|want|handle|write|produce|draft|request|question|ask|information|document|text|topic|matter|subject|point|this|that|it|here)\b"
_DECLINE = r"\b(?:declin(?:e|ing)|refus(?:e|ing)|pass(?:ing)?(?: on)?|skip(?:ping)?|abstain|refrain|bow out|stay out|turn(?:ing)? (?:this|that|it|your request )?down|leave (?:this|that|it) (?:one )?unanswered|sit (?:this|that|it)(?: one)? out|say no|hold back)\b"
_CLAUSE = r"[^.!?;:]*"
REFUSALS = [
    rf"{_SELF}{_CLAUSE}{_NOT}{_CLAUSE}{_TASK}|{_NOT}{_CLAUSE}\b(?:by|for|from) (?:me|us)\b",
    rf"\b(?:i|we)(?:['’](?:m|d|ll|re|ve))?\b(?:,? \w+)?{_CLAUSE}{_DECLINE}",
    rf"\b(?:guidelines?|rules?|polic(?:y|ies)|instructions?)\b{_CLAUSE}(?:{_NOT}|\b(?:forbids?|prevents?|prohibits?|bars?|stops?|keeps?)\b){_CLAUSE}\b(?:me|us)\b",
    r"\bno (?:answer|summary|reply|comment|help)\b[^.!?;:]*\b(?:by|from) (?:me|us)\b|\b(?:beyond|outside|not something|nothing|not a question)\b[^.!?;:]*\b(?:i|we) (?:can|may|am|are|will|could)\b",
    r"\b(?:ist|wäre) (?:es )?mir (?:leider )?(?:nicht|untersagt|verboten)\b|\bich (?:bin|sehe mich|fühle mich)\b[^.!?;:]*\b(?:nicht|außerstande)\b|\bich (?:lehne|verweigere|verzichte|passe|möchte|werde)\b[^.!?;:]*\b(?:ab|nicht|keine?|darauf)\b",
    r"\bje (?:refuse|décline|m['’]abstiens|préfère ne pas|me vois (?:contraint|obligé))|\bne m['’]est pas\b",
    r"\b(?:prefiero no|me niego|me veo obligad[oa]|no se me permite|no voy a)\b|\b(?:prefiro não|recuso|não vou|não me é)\b|\b(?:preferisco non|mi rifiuto|non intendo|non mi è)\b",
    r"\bik (?:weiger|wil|zal|geef)\b[^.!?;:]*\b(?:niet|geen|liever)\b|\bik weiger\b|\bis (?:het )?mij niet\b|\bben ik niet\b",
    r"я (?:отказываюсь|не буду|не стану|не готов)|не имею права|我(?:拒绝|不会|无权|不得|不想)|お答えしかね|(?:回答|お答え|対応)(?:は|を)?(?:控え|できません|いたしかね)|मैं [^।]*(?:असमर्थ|इनकार)|(?:لن أ|لا أقدر|لست مخول|يتعذر علي|أمتنع)",
    r"\b(?:dabei|dazu|damit|hierbei|hierzu)? ?(?:kann|darf) ich\b[^.!?]*\b(?:nicht|keine?)\b|\bich (?:kann|darf)\b[^.!?]*\b(?:nicht|keine?)\b|\b(?:muss ich|ich muss)\b[^.!?]*\b(?:ablehnen|verweigern)\b|\bdarf ich nicht beantworten\b",
    r"\bje ne (?:peux|puis|suis)\b[^.!?]*|\bje dois (?:refuser|décliner)\b|\bil m['’]est impossible\b|\bil ne m['’]est pas\b",
    r"\bno (?:puedo|podemos|estoy autorizad[oa]|me es posible|me está permitido|estoy en condiciones)\b|\b(?:debo|tengo que) (?:rechazar|negarme|declinar)\b",
    r"\bnão (?:posso|podemos|me é possível|estou autorizad[oa]|consigo)\b|\b(?:tenho de|tenho que|devo) (?:recusar|declinar)\b",
    r"\bnon (?:posso|possiamo|mi è possibile|sono autorizzat[oa]|sono in grado|mi è consentito)\b|\b(?:devo|debbo) (?:rifiutare|declinare)\b",
    r"\b(?:kan ik|ik kan|mag ik|ik mag)\b[^.!?]*\b(?:niet|geen)\b|\b(?:ik moet|moet ik)\b[^.!?]*\b(?:weigeren|afwijzen)\b",
    r"\bя (?:не могу|не вправе|вынужден|вынуждена|не имею права|должен отказать)\b|\bмне (?:нельзя|запрещено|не разрешено)\b|\bвынужден[аы]? отказать\b",
    r"我(?:不能|无法|無法|必须拒绝|不便|没有办法|不可以)|(?:不能|无法)(?:回答|协助|提供|帮助)|恕我(?:不能|无法)",
    r"お断り(?:いた)?します|お手伝いできません|お答え(?:すること(?:は|が))?できません|回答できません|ご?提供できません|応じられません|お答えいたしかねます",
    r"मैं [^।]*(?:नहीं (?:कर|दे) सकता|नहीं (?:कर|दे) सकती|अस्वीकार|मना कर)|मुझे [^।]*(?:अस्वीकार|मना|अनुमति नहीं)",
    r"لا (?:يمكنني|أستطيع|يسعني|يحق لي|يجوز لي)|(?:علي|يجب) أن أرفض|يجب علي رفض|مضطر (?:إلى|لرفض)|أعتذر عن (?:عدم )?(?:الإجابة|تقديم)|علي رفض|أرفض",
]
_REFUSAL = re.compile("|".join(f"(?:{r})" for r in REFUSALS), re.IGNORECASE)
#: Letters that may stand beside the refusing sentence: courtesies and referrals.
COURTESY = re.compile(
    r"anything else|please contact|may want to ask|instead|adviser|thank you|bitte wenden|filiale|adressez|votre agence|consulte con|sucursal|fale com|sua agência|si rivolga|contact op|filiaal|обратитесь|отделение|请联系|分行|支店|お問い合わせ|शाखा|संपर्क|مراجعة الفرع|الفرع|sorry|désolé|leider|lamento|spiace|spijt|сожалени|抱歉|申し訳|क्षमा|खेद|آسف|عذرا|apolog|unfortunately|malheureusement|purtroppo|infelizmente|helaas",
    re.IGNORECASE,
)
_TAIL = re.compile(r"(?:\s*(?:\((?:ref\.\s*)?(?:\[[A-Z][A-Z0-9_]*\](?:,\s*)?)+\)|\[{1,2}[A-Z][A-Z0-9_]*_\d+\]{1,2}(?:\s*->\s*\[[A-Z][A-Z0-9_]*_\d+\])?\.?))+\s*$")
_PLACEHOLDER = re.compile(r"\[{1,2}[A-Z][A-Z0-9_]*\]{1,2}")
_END = re.compile(r"[.!?…。！？｡؟।॥．!?]$")
_ITEM = re.compile(r"^\s*(?:[-*•‣▪–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+(?=\S)")
#: Abbreviations that cannot end a sentence.
OPEN_ABBREVIATIONS = {"approx", "no", "vs", "cf", "sec", "fig", "mr", "ms", "mrs", "dr", "nr", "abs", "z", "z. b", "d", "núm", "art", "c.-à-d", "p", "p. ej", "n", "см", "п", "т", "bijv", "d.w.z", "sig", "dott", "m", "sr", "sra", "p.o", "i.e", "e.g", "st", "ca", "г", "ул", "г-н", "dhr", "mevr", "exma"}
_CLOSERS = {")": "(", "]": "[", "}": "{", "”": "“„", "“": "„", "»": "«", "」": "「", "』": "『", "›": "‹"}
_OPENERS = set("([{“„«「『‹")


def _bare(text: str) -> str:
    """Letters and digits only, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum() or unicodedata.category(c)[0] == "M")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = "".join(c for c in answer if unicodedata.category(c) not in ("Cf", "Cc")).strip()
    if not any(c.isalnum() for c in t):
        return not any(unicodedata.category(c) == "So" for c in t)
    return t.strip(" \t\n.<>[](){}\"'`*_-–—:!").lower() in STAND_INS or t.lower() in STAND_INS


def still_open(text: str) -> list[str]:
    """What the pushdown parser has on its stack at the end of text."""
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        if text.startswith("```", i):
            if stack and stack[-1] == "```":
                stack.pop()
            else:
                stack.append("```")
            i += 3
            continue
        c = text[i]
        if stack and stack[-1] == "```":
            pass
        elif text.startswith("**", i):
            if "**" in stack:
                while stack.pop() != "**":
                    pass
            else:
                stack.append("**")
            i += 2
            continue
        elif c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            elif '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append('"')
        elif c == "“" and stack and stack[-1] == "„":
            stack.pop()
        elif c in _OPENERS:
            stack.append(c)
        elif c in _CLOSERS and any(s in _CLOSERS[c] for s in stack):
            while stack.pop() not in _CLOSERS[c]:
                pass
        i += 1
    return stack


def tiles(a: list, b: list, least: int) -> tuple[int, int]:
    """Greedy string tiling: (units of a, units of b) covered by common runs of at least `least` units, longest first."""
    used_a, used_b = [False] * len(a), [False] * len(b)
    where: dict = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    covered = 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            if used_a[i]:
                continue
            for j in where.get(a[i], ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return covered, covered
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = [True] * best
                used_b[j : j + best] = [True] * best
                covered += best


def is_copy(question: str | None, answer: str) -> bool:
    """The question again and next to nothing else, in whatever dress."""
    if not question:
        return False
    q, a = _bare(question), _bare(_PLACEHOLDER.sub(" ", answer))
    if len(q) < 6 or not len(q) * 0.9 <= len(a) <= 2.4 * len(q) + 30:
        return False
    if q == a:
        return True
    # words of the spaced scripts, characters of the others
    unit = (lambda s: [_bare(w) for w in s.split() if _bare(w)]) if " " in question.strip() else (lambda s: list(_bare(s)))
    x, y = unit(question), unit(_PLACEHOLDER.sub(" ", answer))
    covered, _ = tiles(x, y, 2)
    # said twice, it is still the question only
    rest = len(y) - covered
    if covered >= 0.95 * len(x) and rest > max(4, 0.25 * len(x)):
        rest -= len(x) if _bare(answer).count(q) > 1 else 0
    return covered >= 0.92 * len(x) and rest <= max(4, 0.3 * len(x))


def is_refusal(answer: str) -> bool:
    t = _TAIL.sub("", answer).strip()
    rest = 0
    for s in re.split(r"(?<=[.!?。！？।؟])\s*", t):
        if any(c.isalnum() for c in s):
            if not COURTESY.search(s) and not _REFUSAL.search(s):
                rest += sum(map(str.isalnum, s))
                if rest > 15:
                    return False
    return bool(_REFUSAL.search(t))


def last_item(answer: str) -> str | None:
    """The last item of the list an answer ends in, in its bare words; None if it doesn't end in one."""
    lines = [x for x in answer.strip().split("\n") if x.strip()]
    if not lines or not _ITEM.match(lines[-1]):
        return None
    return _item_key(lines[-1])


def _item_key(line: str) -> str:
    return re.sub(r"\s+", " ", _ITEM.sub("", line)).strip().strip("*_`").lower()


def items(answer: str | None) -> list[str]:
    return [_item_key(x) for x in (answer or "").split("\n") if _ITEM.match(x)]


def is_truncated(answer: str, common: dict[str, int], broken: set[str]) -> bool:
    """common: list items of all answers with their counts; broken: items that are mere beginnings of common ones."""
    otherwise, key = truncation(answer)
    return otherwise if key is None or key not in broken and key not in common else key in broken


def truncation(answer: str) -> tuple[bool, str | None]:
    """(whether it is truncated, None); or, if the items of all answers decide, (whether it is truncated if none is its last item, that item)."""
    t = _TAIL.sub("", answer).rstrip()
    t = "".join(c for c in t if unicodedata.category(c) != "Cf").rstrip()
    t = re.sub(r"(?:\s*\n\s*[-–—*_=~#•.]+)+$", "", t).rstrip() if not re.search(r"\n\s*(?:[-*•]|\d+\.)\s+\S[^\n]*\n\s*[-*•.]$", t) else t
    while t and (unicodedata.category(t[-1]) in ("So", "Sk") or t[-1] in "️‍"):
        t = t[:-1].rstrip()
    if not t:
        return False, None
    stack = still_open(t)
    if stack:
        return True, None
    lines = [x for x in t.split("\n") if x.strip() and x.strip() != "```"]
    if not lines:
        return False, None
    last = lines[-1].rstrip()
    if _ITEM.match(last):
        key = _item_key(last)
        if _END.search(key):
            return _open_end(key), None
        # an item nobody else has: complete if the others don't end in marks and it doesn't break off in a word
        others = [x for x in lines[:-1] if _ITEM.match(x)]
        return any(_END.search(x.rstrip()) for x in others), key
    if re.match(r"^\s*(?:[-*•‣▪–]|\(?\d{1,3}[.)])$", last):
        return True, None
    core = last.rstrip(")]}\"'”“»’」』›*_` ")
    if _END.search(core):
        return _open_end(core), None
    return True, None


def _open_end(core: str) -> bool:
    """A final period that only abbreviates."""
    if not core.endswith(".") or core.endswith(".."):
        return False
    word = core[:-1].split()[-1].lstrip("([{\"'“„«").lower() if core[:-1].split() else ""
    return word in OPEN_ABBREVIATIONS


def count_items(pairs: DataFrame) -> DataFrame:
    """(item, n): list items of all answers, with the number of different answers that hold each."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks, out = [], []
        for m, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set(items(a))
            out += own
            marks += [m] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(marks, pa.int64())], ["item", "mark"])

    listed = map_arrow(pairs.where("answer is not null").select(F.xxhash64("answer").alias("mark"), "answer"), fn, "item string, mark long")
    return listed.distinct().groupBy("item").agg(F.count("*").alias("n"))


def _marks(text: Column) -> tuple[Column, Column]:
    """Two digests of 64 bits, which stand for text in joins."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


#: Letters of spaced scripts, with their marks.
_IN_WORD = r"^[\p{L}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]{2}$"


def item_states(pairs: DataFrame) -> DataFrame:
    """(h1, h2, broken): a row for each list item of all answers, by its digests. broken: a mere beginning of one that more than two answers have, and more than four times as many; or of one that more answers have,
    if it breaks off inside a word.

    Each item that several answers have gives its beginnings their counts, so nothing is sorted, collected or left out; no other one can be more common than another."""
    row = lambda s, own, longer, within: F.struct(_marks(s)[0].alias("h1"), _marks(s)[1].alias("h2"), own.cast("long").alias("own"), longer.cast("long").alias("longer"), within.cast("long").alias("within"))
    none = F.lit(None)
    inside = lambda k: F.substring(F.col("item"), k, F.lit(2)).rlike(_IN_WORD)
    begins = F.transform(F.sequence(F.lit(1), F.length("item") - 1), lambda k: row(F.substring(F.col("item"), F.lit(1), k), none, F.col("n"), F.when(inside(k), F.col("n"))))
    rows = F.concat(F.array(row(F.col("item"), F.col("n"), none, none)), F.when((F.col("n") > 1) & (F.length("item") > 1), begins).otherwise(F.array()))
    found = count_items(pairs).select(F.explode(rows).alias("r")).select("r.*").groupBy("h1", "h2").agg(*(F.max(c).alias(c) for c in ("own", "longer", "within")))
    return found.where("own is not null").select("h1", "h2", F.expr("coalesce(longer > 2 and longer > 4 * own, false) or coalesce(within > own, false)").alias("broken"))


#: Script of a letter by its code point: Latin, Cyrillic, Arabic, Devanagari, Chinese and Japanese characters.
_SCRIPTS = re.compile("([A-Za-zÀ-ɏ])|([Ѐ-ԯ])|([؀-ۿ])|([ऀ-ॿ])|([぀-ヿ㐀-鿿])")


def script(text: str, least: int = 4) -> int:
    """The script of three quarters and more of the letters, if there are at least so many of them: 1 to 5, 0 for none."""
    counts = [0] * 6
    for m in _SCRIPTS.finditer(text):
        counts[m.lastindex] += 1
    most = max(counts)
    return counts.index(most) if most >= least and 4 * most >= 3 * sum(counts) else 0


def _plain(text: str) -> str:
    return _usable(_PLACEHOLDER.sub(" ", text))


def find_defects(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """pairs: row_id, question, answer. (row_id, defect): one row for each pair, defect null where there is none."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        questions, answers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        plain_q, plain_a = [_plain(q or "") for q in questions], [_plain(_TAIL.sub("", a or "")) for a in answers]
        qs, nq = scores(plain_q, w)
        as_, na = scores(plain_a, w)
        out, last = [], []
        for k, (q, a) in enumerate(zip(questions, answers)):
            item = None
            if is_empty(a):
                out.append("empty")
            elif is_copy(q, a):
                out.append("copy")
            elif is_refusal(a):
                out.append("refusal")
            elif q and (0 != script(plain_q[k]) != script(plain_a[k]) != 0 or _other_language(qs[k], as_[k], int(nq[k]), int(na[k]))):
                out.append("wrong_language")
            else:
                truncated, item = truncation(a)
                out.append("truncated" if truncated else None)
            last.append(item)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(last, pa.string())], ["row_id", "defect", "item"])

    looked = map_arrow(spread(pairs.select("row_id", "question", "answer")), fn, "row_id long, defect string, item string")
    h1, h2 = _marks(F.col("item"))
    # rows without an item meet none (h2 is null) and are spread by their id
    looked = looked.withColumn("h1", F.when(F.col("item").isNull(), F.xxhash64("row_id")).otherwise(h1)).withColumn("h2", F.when(F.col("item").isNotNull(), h2))
    joined = looked.drop("item").join(item_states(pairs), ["h1", "h2"], "left")
    return joined.select("row_id", F.when(F.col("broken").isNull(), F.col("defect")).when(F.col("broken"), "truncated").alias("defect"))


def _other_language(q: np.ndarray, a: np.ndarray, nq: int, na: int) -> bool:
    """Whether the answer is surely in one language, and the question hardly can be in it."""
    if nq < 4 or na < 4 or q.argmax() == a.argmax():
        return False
    pq, pa_ = (np.exp(SHARPNESS * (s - s.max())) for s in (q, a))
    pq, pa_ = pq / pq.sum(), pa_ / pa_.sum()
    return pa_.max() >= LEAST_CONFIDENCE and a.max() - a[q.argmax()] > 0.25 and pq[a.argmax()] < 0.15 and pq.max() > 3 * pq[a.argmax()]


def pairs_of(demo_run: DataFrame, answer: DataFrame) -> DataFrame:
    """(table_name, row_id, question, answer) of both tables, each id once. An answer's question is that of its demo_id."""
    first = lambda df, key, at, *rest: df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(F.struct(at, *rest)).alias("m")).select(key, "m.*")
    runs = first(demo_run, "demo_id", "generated_at", "question", F.col("answer_as_returned").alias("answer"))
    tries = first(answer, "answer_id", "arrived_at", F.col("demo_id").cast("long").alias("demo_id"), F.col("text").alias("answer")).withColumnRenamed("answer_id", "row_id")
    return runs.select(F.lit("demo_run").alias("table_name"), F.col("demo_id").alias("row_id"), "question", "answer").unionByName(
        tries.join(runs.select("demo_id", "question"), "demo_id", "left").select(F.lit("answer").alias("table_name"), "row_id", "question", "answer")
    )



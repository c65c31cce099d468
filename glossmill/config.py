"""What is particular to a domain: vocabularies, marks and bounds, given to operators as values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Domain:
    """Vocabulary of a collection. All operators take one; none has words of its own."""

    # Sentence marks, lengths and windows of the project's own units, measures and suffixes of preparations.
    sentence_marks: str = "。！？!?；;"
    paragraph_chars: int = 900
    window: int = 6
    overlap: int = 2
    quote_chars: int = 240
    most_questions: int = 12
    measure: str = r"\d+(?:\.\d+)?\s*(?:克|钱|两|分|升|斗|斤|铢)"
    formula_suffixes: tuple[str, ...] = ("汤", "丸", "散", "饮", "膏", "丹")
    # Words of a warning.
    caution_terms: tuple[str, ...] = ("不可", "不可以", "勿", "误", "禁忌", "忌")
    #: Kinds of terms and their vocabularies; those of a collection are given by its owner, these are examples.
    vocabularies: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "organ": ("心气", "肝血", "脾阳", "肺津", "肾精", "胃火", "胆热", "膀胱", "三焦", "大肠", "小肠", "营卫"),
        "sign": ("胀满", "发热", "恶心", "盗汗", "口渴", "鼻塞", "多梦", "便溏", "尿频", "健忘", "头顶", "胃脘", "咽中", "腰间"),
    })
    #: Traditional characters with their simplified forms, in pairs; a collection with rarer ones gives its own.
    script_pairs: str = (
        "錢钱 兩两 斤斤 藥药 湯汤 飲饮 證证 脈脉 陰阴 陽阳 氣气 營营 衛卫 虛虚 實实 風风 濕湿 熱热 燒烧 發发 惡恶 瀉泻 頭头 頸颈 項项 臟脏 腦脑 膽胆 腎肾 腸肠 "
        "脹胀 滿满 腫肿 痠酸 癢痒 瘡疮 經经 絡络 針针 點点 體体 歲岁 時时 節节 來来 從从 後后 開开 關关 門门 問问 間间 聞闻 閉闭 陳陈 隨随 難难 離离 雲云 霧雾 靜静 "
        "頁页 題题 類类 顏颜 養养 餘余 館馆 馬马 驗验 驚惊 骨骨 魚鱼 鳥鸟 鴨鸭 鷹鹰 鹽盐 麥麦 麼么 黃黄 齒齿 齡龄 龍龙 龜龟 書书 會会 東东 條条 極极 樂乐 歸归 殘残 "
        "氣气 涼凉 測测 準准 溫温 滲渗 無无 為为 爭争 現现 產产 畫画 異异 當当 療疗 盡尽 眾众 種种 穩稳 穀谷 積积 紅红 紫紫 細细 終终 組组 給给 絲丝 綠绿 緊紧 線线 緩缓 縮缩 "
        "聲声 聽听 肅肃 腳脚 臨临 與与 舉举 舊旧 葉叶 處处 號号 蘭兰 蟲虫 術术 裡里 裏里 補补 製制 複复 見见 規规 視视 覺觉 觀观 計计 記记 訴诉 診诊 試试 該该 說说 請请 "
        "論论 講讲 識识 譜谱 讀读 變变 讓让 貝贝 貫贯 責责 資资 質质 車车 軟软 較较 輕轻 輔辅 轉转 辨辨 農农 過过 達达 遠远 適适 遲迟 還还 邊边 鄉乡 醫医 釋释 鐘钟 長长"
    )
    #: What ends a run of ideographs without meaning anything, and pieces that make a term say nothing.
    particles: str = "的了呢吗"
    generic: tuple[str, ...] = ("这个", "那个", "问题", "内容", "时候")
    #: Words that may be in a question but never look for anything.
    stop_terms: tuple[str, ...] = ("我们", "他们", "因为", "所以", "如果", "可以", "就是", "没有", "现在")
    method_terms: tuple[str, ...] = ("炮制", "煮取", "针", "灸", "按")
    comparison_terms: tuple[str, ...] = ("相较", "鉴别", "区别", "区分")
    #: Intent, and the words of which one in a query shows it; the first that holds wins.
    intents: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("dosage", ("用量", "剂量", "多少", "几克")),
        ("source_lookup", ("出自", "出处", "哪一讲", "原文")),
        ("comparison", ("区分", "区别", "比较", "鉴别")),
        ("caution", ("禁忌", "不可", "注意")),
        ("method", ("怎么", "如何", "煎服")),
    )
    #: Words of a question that say nothing about its topic.
    scaffold: tuple[str, ...] = ("请问", "关于", "怎么煎服", "的用量是多少", "用量如何掌握", "主治哪些证候", "出自哪一讲", "有什么禁忌", "如何区分", "什么", "怎么", "如何", "哪些", "多少", "与")
    #: Questions that a paragraph answers: for each of its preparations, for its first two, for each term of a kind, for words it holds, or else for its title.
    preparation_questions: tuple[str, ...] = ("{t}用于哪些情形？", "哪里讲到{t}？")
    pair_question: str = "{a}与{b}有什么不同？"
    kind_questions: dict[str, str] = field(default_factory=lambda: {"organ": "与{t}有关的要点有哪些？", "sign": "出现{t}时看哪一段？"})
    title_question: str = "《{t}》的这一段讲了什么？"

    @property
    def word_questions(self) -> tuple[tuple[tuple[str, ...], str], ...]:
        return ((self.caution_terms, "这一段提醒避免什么？"), (self.comparison_terms, "这一段比较了什么？"))

    @property
    def terms(self) -> tuple[str, ...]:
        """The terms of all kinds."""
        return tuple(t for terms in self.vocabularies.values() for t in terms)

    @property
    def scripts(self) -> tuple[str, str]:
        """Characters and what they are folded to, in the same order, each once."""
        pairs = dict((p[0], p[1]) for p in self.script_pairs.split() if p[0] != p[1])
        return "".join(pairs), "".join(pairs.values())

    # Weights of the kinds of retrieval units.
    weights: dict[str, float] = field(default_factory=lambda: {"sentence": 1.0, "window": 1.1, "paragraph": 0.9, "question": 1.15})


DOMAIN = Domain()
# Bounds of the public interface and the constant of reciprocal-rank fusion.
MOST_RESULTS, MOST_INTERNAL, RANK_CONSTANT = 100, 400, 60


def checked_limit(value: object, name: str = "limit", most: int = MOST_RESULTS) -> int:
    """A whole number from 1 to `most`, or an error that says so."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be a whole number")
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be from 1 to {most}")
    return value

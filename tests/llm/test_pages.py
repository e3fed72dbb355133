"""Pages of one block, without tags, in other scripts, cut off, and with notices that only their words give away."""

from __future__ import annotations

import pytest

from quillspark.llm import common
from quillspark.llm.html_blocks import leaf_blocks
from quillspark.llm.html_extraction import default_field, extract, main_text, saved_field

PROSE = (
    "The council met on Tuesday to discuss the new bridge over the river, which has been planned for ten years. Several members asked about the cost. "
    "The mayor said that the work would begin in spring, and that the old bridge would stay open."
)
CHINESE = "市议会周二开会讨论横跨河流的新桥，该桥已规划十年。几名议员询问费用问题。市长表示，工程将于春季开始，旧桥将继续开放。居民们对此表示欢迎，认为新桥将改善交通状况。"
RUSSIAN = "Городской совет собрался во вторник, чтобы обсудить новый мост через реку. Несколько членов спросили о стоимости. Мэр сказал, что работы начнутся весной."
ARABIC = "اجتمع المجلس يوم الثلاثاء لمناقشة الجسر الجديد فوق النهر، الذي خطط له منذ عشر سنوات. وسأل عدة أعضاء عن التكلفة. وقال العمدة إن العمل سيبدأ في الربيع."
HINDI = "परिषद ने मंगलवार को नदी पर नए पुल पर चर्चा करने के लिए बैठक की। कई सदस्यों ने लागत के बारे में पूछा। महापौर ने कहा कि काम वसंत में शुरू होगा।"
PAGES = {
    "one block": (f"<html><body>{PROSE}", PROSE),
    "one division": (f"<body><div>{PROSE * 3}", PROSE * 3),
    "no tag": (PROSE, PROSE),
    "Chinese": (f"<html><body><div>{CHINESE}</div><div>{CHINESE}</div></body></html>", f"{CHINESE}\n{CHINESE}"),
    "Russian": (f"<p>{RUSSIAN}</p>", RUSSIAN),
    "Arabic": (f"<div><p>{ARABIC}</p></div>", ARABIC),
    "Hindi": (f"<body><p>{HINDI}</p><p>{HINDI}</p>", f"{HINDI}\n{HINDI}"),
    "cut in a tag": (f'<p>{PROSE}</p><a href="http://x.y/z?a=b', PROSE),
    "aria-hidden is seen": (f'<p>{PROSE} <span aria-hidden="true">5 EUR</span></p>', f"{PROSE} 5 EUR"),
    "plain notice": (f"<div>We use cookies to improve your visit. Accept all.</div><div><p>{PROSE}</p><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
    "posts of users": (f'<div><p>{PROSE}</p><p>{PROSE}</p></div><div class="user-posts"><p>Great piece, thanks for writing it.</p></div>', f"{PROSE}\n{PROSE}"),
    "links only": ("<html><body><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></body></html>", ""),
    "Chinese links around": (f"<body><div><a href=/>首页</a> <a href=/b>新闻</a> <a href=/c>关于我们</a></div><div><p>{CHINESE}</p><p>{CHINESE}</p></div><div>© 2024 版权所有</div>", f"{CHINESE}\n{CHINESE}"),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    html, want = PAGES[name]
    assert main_text(html, default_field())[0] == want


def test_a_cut_tag_is_no_text():
    assert [b.text for b in leaf_blocks("<p>a</p>b <i class='x")] == ["a", "b"]
    assert [b.text for b in leaf_blocks("a <b")] == ["a"] and [b.text for b in leaf_blocks("a < b")] == ["a < b"]


def test_the_saved_model_decodes_alike(spark):
    first, again = saved_field(spark), saved_field(spark)
    for html, _ in PAGES.values():
        blocks = leaf_blocks(html)
        assert first.decode(blocks) == again.decode(blocks) == default_field().decode(blocks)
    rows = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(PAGES.values())], "page_id long, html string").selectExpr("page_id", "null as url", "html")
    assert {r["page_id"]: r["text"] for r in extract(rows).collect()} == {i: want for i, (_, want) in enumerate(PAGES.values())}
    assert common.shared_dir(spark)

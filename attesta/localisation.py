"""Names of things in the four languages of the data, and the labels that are made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import single_line

# ---- fixed values --------------------------------------------------------------------------------------------------
LANGUAGES = ("en", "kr", "jp", "cn")
#: domain, key, and the name in each language.
NAMES = """
currency | 3 | Pyroxene | 청휘석 | 青輝石 | 青輝石
currency | 1 | Credit | 크레딧 | クレジット | 學園幣
cost | 5 | AP | AP | AP | AP
cost | 22 | Bounty Ticket | 현상수배 티켓 | 指名手配チケット | 懸賞通緝票券
cost | 23 | Scrimmage Ticket | 학원교류회 티켓 | 学園交流会チケット | 學園交流會票券
stage | ChaserA | Overpass | 고가도로 | ハイウェイ | 高架公路
stage | ChaserB | Abandoned Train | 버려진 기차 | 捨てられた列車 | 被遺棄的列車
stage | ChaserC | Besieged Classroom | 습격 받은 교실 | 襲撃された校舎 | 被襲擊的教室
stage | FindGift | Item Retrieval | 슬럼피아 광장 | スランピア広場 | 史林皮亞廣場
stage | Blood | Base Defense | 폐허의 군수공장 | 軍需工場の廃墟 | 廢墟軍需工廠
stage | SchoolA | Trinity | 트리니티 | トリニティ | 三一
stage | SchoolB | Gehenna | 게헨나 | ゲヘナ | 格黑娜
stage | SchoolC | Millennium | 밀레니엄 | ミレニアム | 千年
category | Campaign | Campaign | 캠페인 | 任務 | 任務
category | Bounty | Bounty | 현상수배 | 指名手配 | 懸賞通緝
category | WeekDungeon | Commissions | 특별의뢰 | 特別依頼 | 特別委托
category | SchoolDungeon | Scrimmage | 학원교류회 | 学園交流会 | 學園交流會
item | Material | Material | 재료 | 素材 | 材料
item | Coin | Currency | 재화 | アイテム | 道具
item | CharacterExpGrowth | Character EXP | 캐릭터 경험치 | キャラクターEXP | 經驗書
item | Favor | Gift | 선물 | 贈り物 | 禮物
item | SecretStone | Eleph | 엘레프 | 神名文字 | 神名文字
item | Consumable | Consumable | 소모품 | 消費アイテム | 消耗品
item | Collectible | Collectible | 수집품 | 収集品 | 收藏品
equipment | Exp | Enhancement Stone | 강화석 | 強化珠 | 強化珠
equipment | WeaponExpGrowthA | Weapon Part (Spring) | 무기 부품 (스프링) | 武器パーツ (スプリング) | 武器零件 (擊錘)
equipment | WeaponExpGrowthB | Weapon Part (Hammer) | 무기 부품 (해머) | 武器パーツ (ハンマー) | 武器零件 (彈簧)
equipment | WeaponExpGrowthC | Weapon Part (Barrel) | 무기 부품 (총열) | 武器パーツ (銃身) | 武器零件 (槍管)
equipment | WeaponExpGrowthZ | Weapon Part (Firing Pin) | 무기 부품 (공이) | 武器パーツ (撃針) | 武器零件 (擊針)
equipment | Hat | Hat | 모자 | 帽子 | 帽子
equipment | Gloves | Gloves | 장갑 | グローブ | 手套
equipment | Shoes | Shoes | 신발 | シューズ | 鞋子
equipment | Bag | Bag | 가방 | バッグ | 包包
equipment | Badge | Badge | 배지 | バッジ | 徽章
equipment | Hairpin | Hairpin | 헤어핀 | ヘアピン | 髮夾
equipment | Charm | Amulet | 부적 | お守り | 護符
equipment | Necklace | Necklace | 목걸이 | ネックレス | 項鍊
equipment | Watch | Wristwatch | 손목시계 | 腕時計 | 手錶
"""
# --------------------------------------------------------------------------------------------------------------------


def names(spark: SparkSession) -> DataFrame:
    """(domain, key, lang, text): the table that ``rewards.translated`` joins."""
    rows = [line.split(" | ") for line in NAMES.strip().splitlines()]
    return spark.createDataFrame([(domain, key, lang, text) for domain, key, *texts in rows for lang, text in zip(LANGUAGES, texts, strict=True)], "domain string, key string, lang string, text string")


def item_label(category: Column, name: Column, item_id: Column) -> Column:
    """How an item is shown; ``category`` is in the reader's language, ``name`` may have line breaks."""
    return F.format_string("[%s] %s (#%s)", category, single_line(name), item_id.cast("string"))


def equipment_label(tier: Column, category: Column, name: Column, item_id: Column) -> Column:
    return F.format_string("[%s%s] %s (#%s)", F.when(tier > 0, F.concat(F.lit("Tier "), tier.cast("string"), F.lit(" "))).otherwise(""), category, name, item_id.cast("string"))


def known(text: Column, what: Column) -> Column:
    """A translated text; one that the table doesn't have stops the query."""
    return F.coalesce(text, F.raise_error(F.concat(F.lit("unknown name: "), what)))

"""Typed forms of catalogue entries, and their closed-world checks.

A catalogue stays VARIANT until ``sources.readers.typed`` gives it a schema.  Entries with variants by category share one
schema with every column; ``required`` and ``optional`` then say which keys an entry of a category must and may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------------------------------------------------
REWARD = "struct<Type: string, Id: long, Amount: long, AmountMin: long, AmountMax: long, Chance: double, RewardType: string>"
FORMATION = "struct<Id: long, LevelMinion: int, GradeMinion: int, EnemyList: array<long>, MapIcon: string, MoveType: string, UnitGrade: string>"
GROUP_ITEM = "struct<Type: string, Id: long, Chance: double, AmountMin: long, AmountMax: long>"
RECIPE = "struct<Released: array<boolean>, RequireItem: array<long>, RequireGold: long, IngredientTag: array<string>, IngredientExp: long>"
CHOICE = "struct<Type: string, Id: long, AmountMin: long, AmountMax: long>"
BONUS = "struct<Global: array<array<long>>, Cn: array<array<long>>, Jp: array<array<long>>>"
SHOP = "struct<ShopCategory: string, Released: array<boolean>, Amount: long, CostType: string, CostId: long, CostAmount: long>"

STAGE = (
    f"Id long, Category string, EntryCost array<array<long>>, StarCondition array<long>, Rewards array<{REWARD}>, Terrain string, Level int, ArmorTypes array<string>, "
    f"ServerData map<string, struct<Rewards: array<{REWARD}>, Formations: array<{FORMATION}>>>, Formations array<{FORMATION}>, Name string, Area int, Stage string, Difficulty int, "
    "ChallengeCondition array<array<string>>, HexaMap array<struct<Pos: array<int>, Start: boolean, Formation: int>>, Type string"
)
GROUP = f"Items array<{GROUP_ITEM}>, ItemsCn array<{GROUP_ITEM}>, ItemsGlobal array<{GROUP_ITEM}>, Recursive boolean, RewardAll boolean"
ITEM = (
    "Id long, IsReleased array<boolean>, Category string, Rarity string, Quality int, Tags array<string>, Craftable array<boolean>, StageDrop array<boolean>, Shop array<boolean>, Icon string, Name string, Desc string, "
    f"CraftQuality int, ShiftingCraftQuality int, ShiftingCraftQualityCn int, ShiftingCraftQualityGlobal int, ShiftingCraftRecipe {RECIPE}, SubCategory string, EventBonus {BONUS}, EventBonusRerun {BONUS}, EventId long, "
    f"ExpValue long, ConsumeType string, GachaGroupId long, Items array<{CHOICE}>, ItemsCn array<{CHOICE}>, ItemsGlobal array<{CHOICE}>"
)
EQUIPMENT = f"Id long, Category string, Rarity string, Tier int, Icon string, Shops array<{SHOP}>, Name string, Desc string, IsReleased array<boolean>, MaxLevel int, StatType array<string>, StatValue array<array<long>>, LevelUpFeedExp long, Recipe array<array<long>>, RecipeCost long"
FURNITURE = f"Id long, IsReleased array<boolean>, Rarity string, Icon string, Craftable array<boolean>, ComfortBonus int, Category string, Size array<int>, Tags array<string>, CraftQuality int, ShiftingCraftQuality int, ShiftingCraftRecipe {RECIPE}, SubCategory string, SetGroupId long, Name string, Desc string, Interaction array<boolean>, Templates array<array<long>>"

_ITEM_BASE = ("Id", "IsReleased", "Category", "Rarity", "Quality", "Tags", "Craftable", "StageDrop", "Shop", "Icon", "Name", "Desc")
_STAGE_BASE = ("Id", "Category", "EntryCost", "StarCondition", "Rewards", "Terrain", "Level", "ArmorTypes", "Formations")
#: (keys that an entry must have, keys that it may have) by model and category; "" where categories don't matter.
KEYS: dict[str, dict[str, tuple[tuple[str, ...], tuple[str, ...]]]] = {
    "stages": {
        "Campaign": ((*_STAGE_BASE, "Name", "Area", "Stage", "Difficulty", "ChallengeCondition"), ("ServerData", "HexaMap")),
        "Bounty": ((*_STAGE_BASE, "Type", "Stage"), ("ServerData",)),
        "WeekDungeon": ((*_STAGE_BASE, "Type", "Stage"), ("ServerData",)),
        "SchoolDungeon": ((*_STAGE_BASE, "Type", "Stage"), ("ServerData",)),
    },
    "items": {
        "Material": (_ITEM_BASE, ("CraftQuality", "ShiftingCraftQuality", "ShiftingCraftQualityCn", "ShiftingCraftQualityGlobal", "ShiftingCraftRecipe", "SubCategory")),
        "Coin": (_ITEM_BASE, ("CraftQuality", "EventBonus", "EventBonusRerun", "EventId")),
        "CharacterExpGrowth": ((*_ITEM_BASE, "CraftQuality", "ExpValue"), ()),
        "Favor": ((*_ITEM_BASE, "ExpValue"), ("CraftQuality", "ShiftingCraftQuality")),
        "SecretStone": (_ITEM_BASE, ()),
        "Collectible": (_ITEM_BASE, ("EventId",)),
        "Consumable": (_ITEM_BASE, ("ConsumeType", "GachaGroupId", "Items", "ItemsCn", "ItemsGlobal", "ShiftingCraftQuality", "ShiftingCraftRecipe")),
    },
    "groups": {"": (("Items",), ("ItemsCn", "ItemsGlobal", "Recursive", "RewardAll"))},
    "equipment": {"": (("Id", "Category", "Rarity", "Tier", "Icon", "Shops", "Name", "Desc", "IsReleased", "MaxLevel", "StatType", "StatValue"), ("LevelUpFeedExp", "Recipe", "RecipeCost"))},
    "furniture": {"": (("Id", "IsReleased", "Rarity", "Icon", "Craftable", "ComfortBonus", "Category", "Size", "Tags", "CraftQuality", "SubCategory", "SetGroupId", "Name", "Desc", "Interaction"), ("ShiftingCraftQuality", "ShiftingCraftRecipe", "Templates"))},
}
RARITIES = ("N", "R", "SR", "SSR")
TERRAINS = ("Indoor", "Outdoor", "Street")
ARMORS = ("LightArmor", "HeavyArmor", "Unarmed", "ElasticArmor")
DROPS = ("Currency", "Equipment", "Furniture", "Item")
REWARDS = ("Currency", "GachaGroup", "Equipment", "Item")
#: Categories of equipment whose icons are matched.
ICON_CATEGORIES = ("Hat", "Gloves", "Shoes", "Bag", "Badge", "Hairpin", "Charm", "Watch", "Necklace", "Exp", "WeaponExpGrowthA", "WeaponExpGrowthB", "WeaponExpGrowthC", "WeaponExpGrowthZ")
# --------------------------------------------------------------------------------------------------------------------

SCHEMAS = {"stages": STAGE, "groups": GROUP, "items": ITEM, "equipment": EQUIPMENT, "furniture": FURNITURE}


def _text(keys: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")


def key_violations(entries: DataFrame, model: str) -> DataFrame:
    """(id, problem): entries (id, json) that lack a key, have one too many, or are of no category of the model."""
    have, category = F.json_object_keys("json"), F.get_json_object("json", "$.Category")
    models = KEYS[model]
    must, may, known = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(False)
    for name, (required, optional) in models.items():
        at = (category == name) if name else F.lit(True)
        must, may, known = F.when(at, _text(required)).otherwise(must), F.when(at, _text(required + optional)).otherwise(may), known | F.coalesce(at, F.lit(False))
    problems = F.concat(
        F.transform(F.array_except(must, have), lambda k: F.concat(F.lit("missing "), k)),
        F.transform(F.array_except(have, may), lambda k: F.concat(F.lit("unexpected "), k)),
    )
    return entries.select("id", F.explode(F.when(known, problems).otherwise(F.array(F.lit("unknown category")))).alias("problem"))


def armors_ok(types: Column) -> Column:
    """Armor types are numbers or known names."""
    return F.forall(types, lambda t: t.rlike(r"\A[0-9]+\z") | t.isin(*ARMORS))


def tribool_ok(x: Column) -> Column:
    """A flag for each of the three servers."""
    return F.coalesce(F.size(x) == 3, F.lit(False)) & F.forall(x, lambda v: v.isNotNull())


def equipment_ok(stat_type: Column, stat_value: Column, recipe: Column, cost: Column) -> Column:
    return (F.size(stat_type) == F.size(stat_value)) & (recipe.isNull() == cost.isNull())

"""Attribute flags from word lists. Rule sets that differ on purpose in how they match and in their words; they are never merged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text

# Words of each category. A caller may pass lists of its own.
CATEGORIES = {
    "meat": (
        "beef", "steak", "veal", "lamb", "mutton", "pork", "bacon", "ham", "prosciutto", "pancetta", "salami", "chorizo", "sausage", "pepperoni", "mince", "minced", "ground beef", "ground pork", "ground lamb",
        "venison", "rabbit", "duck", "goose", "turkey", "chicken", "poultry", "quail", "pheasant", "partridge", "pigeon", "liver", "kidney", "offal", "tripe", "tongue", "oxtail", "brisket", "rib", "loin",
        "gammon", "bratwurst", "frankfurter", "hot dog", "mortadella", "bresaola", "coppa", "nduja", "sobrassada", "boudin", "rillettes", "paté", "pate", "terrine", "suet", "dripping", "lard",
        "bone marrow", "stock bone", "gelatin", "gelatine",
    ),
    "poultry": ("chicken", "turkey", "duck", "goose", "quail", "pheasant", "partridge", "pigeon", "guinea fowl", "cornish hen", "capon"),
    "fish": (
        "fish", "salmon", "tuna", "cod", "haddock", "mackerel", "sardine", "anchovy", "anchovies", "herring", "trout", "sea bass", "sole", "plaice", "halibut", "swordfish", "monkfish", "snapper", "pike",
        "perch", "catfish", "tilapia", "pollock", "whitebait", "sprat", "eel", "bream", "dory", "grouper", "mahi", "wahoo", "barramundi", "fish sauce", "fish stock", "bonito", "dashi", "worcestershire",
    ),
    "shellfish": (
        "shrimp", "prawn", "king prawn", "crab", "lobster", "crayfish", "mussel", "clam", "oyster", "scallop", "squid", "calamari", "octopus", "cockle", "whelk", "langoustine", "crawfish", "abalone",
        "sea urchin", "cuttlefish",
    ),
    "pork": (
        "pork", "bacon", "ham", "prosciutto", "pancetta", "salami", "chorizo", "pepperoni", "sausage", "lard", "gammon", "bratwurst", "frankfurter", "hot dog", "mortadella", "coppa", "nduja", "sobrassada",
        "boudin", "rillettes", "crackling", "chicharron",
    ),
    "alcohol": (
        "wine", "red wine", "white wine", "beer", "ale", "lager", "stout", "brandy", "cognac", "rum", "vodka", "whisky", "whiskey", "gin", "tequila", "mezcal", "liqueur", "amaretto", "kahlua", "baileys",
        "champagne", "prosecco", "cava", "sherry", "port", "marsala", "madeira", "vermouth", "sake", "mirin", "kirsch", "grappa", "calvados", "armagnac", "absinthe", "ouzo", "raki", "sambuca", "limoncello",
        "grand marnier", "cointreau", "curaçao", "curacao",
    ),
    "dairy": (
        "milk", "cream", "butter", "cheese", "yoghurt", "yogurt", "curd", "whey", "casein", "ghee", "mascarpone", "ricotta", "mozzarella", "parmesan", "parmigiano", "cheddar", "gruyère", "gruyere", "brie",
        "camembert", "gouda", "emmental", "feta", "halloumi", "paneer", "cottage cheese", "cream cheese", "sour cream", "crème fraîche", "creme fraiche", "double cream", "single cream", "heavy cream",
        "light cream", "clotted cream", "buttermilk", "condensed milk", "evaporated milk", "full-fat milk", "semi-skimmed milk", "skimmed milk", "whole milk", "2% milk", "skim milk", "ice cream", "custard",
        "bechamel", "béchamel", "quark", "labneh", "kefir", "fromage",
    ),
    "egg": ("egg", "eggs", "egg yolk", "egg white", "meringue", "mayonnaise", "aioli", "hollandaise", "quiche", "frittata", "omelette", "omelet"),
    "honey": ("honey",),
    "gluten": (
        "wheat", "flour", "bread", "pasta", "noodle", "spaghetti", "penne", "fusilli", "lasagne", "lasagna", "macaroni", "fettuccine", "linguine", "tagliatelle", "ravioli", "tortellini", "gnocchi", "couscous",
        "bulgur", "semolina", "seitan", "barley", "rye", "spelt", "kamut", "triticale", "breadcrumb", "crouton", "panko", "pita", "pitta", "naan", "tortilla", "wrap", "baguette", "ciabatta", "focaccia",
        "croissant", "pastry", "puff pastry", "filo", "phyllo", "plain flour", "self-raising flour", "strong flour", "all-purpose flour", "bread flour", "cake flour", "wholemeal flour", "whole wheat flour",
        "soy sauce", "malt", "malt vinegar", "beer", "ale", "lager", "stout",
    ),
    "swappable": (
        "flour", "bread", "pasta", "noodle", "spaghetti", "penne", "fusilli", "lasagne", "lasagna", "macaroni", "fettuccine", "linguine", "tagliatelle", "couscous", "breadcrumb", "crouton", "panko", "tortilla",
        "wrap", "soy sauce", "plain flour", "self-raising flour", "all-purpose flour", "bread flour", "cake flour", "wholemeal flour", "whole wheat flour",
    ),
    "nut": (
        "almond", "walnut", "cashew", "pistachio", "hazelnut", "pecan", "macadamia", "brazil nut", "pine nut", "chestnut", "peanut", "nut butter", "almond butter", "peanut butter", "cashew butter",
        "almond milk", "almond flour", "ground almond", "marzipan", "frangipane", "praline", "nougat", "gianduja", "nutella", "tahini",
    ),
}

# Words of the seven flags of ``seven``.
SEVEN = {
    "meat": (
        "beef", "steak", "ground beef", "minced beef", "brisket", "short rib", "ribeye", "sirloin", "chuck", "flank", "skirt steak", "tenderloin", "veal", "oxtail", "tripe",
        "pork", "bacon", "ham", "prosciutto", "pancetta", "salami", "pepperoni", "chorizo", "sausage", "hot dog", "bratwurst", "kielbasa", "lard",
        "pork belly", "pork chop", "pork loin", "pulled pork", "spare rib", "pork rib", "fatback",
        "chicken", "turkey", "duck", "goose", "quail", "pheasant", "guinea fowl", "chicken breast", "chicken thigh", "chicken wing", "whole chicken", "ground turkey", "turkey breast", "rotisserie chicken",
        "lamb", "mutton", "venison", "elk", "bison", "boar", "rabbit", "hare", "kangaroo", "goat meat", "meat", "mince", "ground meat", "deli meat", "cold cut",
        "bone broth", "gelatin", "gelatine", "rennet", "lard", "tallow", "suet", "anchovies", "anchovy", "worcestershire", "fish sauce",
    ),
    "seafood": (
        "fish", "salmon", "tuna", "cod", "halibut", "tilapia", "trout", "bass", "snapper", "grouper", "mahi", "swordfish", "sardine", "mackerel", "herring", "anchovy", "anchovies", "catfish", "pike",
        "perch", "pollock", "haddock", "flounder", "sole", "turbot", "sea bream", "branzino", "sea bass", "shrimp", "prawn", "lobster", "crab", "crayfish", "langoustine",
        "clam", "mussel", "oyster", "scallop", "squid", "calamari", "octopus", "cuttlefish", "abalone", "geoduck", "fish sauce", "oyster sauce", "shrimp paste", "fish paste", "fish stock", "seafood",
    ),
    "shellfish": (
        "shrimp", "prawn", "lobster", "crab", "crayfish", "langoustine", "clam", "mussel", "oyster", "scallop", "squid", "calamari", "octopus", "cuttlefish", "abalone",
        "shrimp paste", "fish sauce", "shellfish",
    ),
    "dairy": (
        "milk", "whole milk", "skim milk", "2% milk", "buttermilk", "cream", "heavy cream", "whipping cream", "double cream", "sour cream", "creme fraiche", "crème fraîche", "butter", "ghee",
        "cheese", "cheddar", "mozzarella", "parmesan", "parmigiano", "gruyere", "swiss cheese", "brie", "camembert", "gouda", "goat cheese", "ricotta", "cottage cheese", "cream cheese", "mascarpone",
        "feta", "halloumi", "manchego", "colby", "provolone", "yogurt", "yoghurt", "greek yogurt", "whey", "casein", "lactose", "evaporated milk", "condensed milk", "powdered milk", "milk powder",
        "ice cream", "half and half", "half-and-half",
    ),
    "egg": ("egg", "eggs", "egg white", "egg yolk", "whole egg", "hard boiled egg", "soft boiled egg", "poached egg", "egg wash", "beaten egg", "meringue", "mayonnaise", "mayo", "hollandaise"),
    "gluten": (
        "flour", "all purpose flour", "all-purpose flour", "bread flour", "cake flour", "pastry flour", "self-raising flour", "self rising flour", "whole wheat flour", "whole grain flour", "spelt flour",
        "einkorn flour", "wheat", "whole wheat", "bulgur", "semolina", "durum", "farro", "spelt", "kamut", "einkorn", "emmer", "barley", "rye", "triticale", "bread", "breadcrumb", "panko", "crouton",
        "pasta", "noodle", "couscous", "cracker", "biscuit", "cookie", "cake", "pita", "naan", "tortilla", "wrap", "soy sauce", "beer", "malt", "malt vinegar", "seitan", "udon", "ramen", "soba",
        "dumpling wrapper", "wonton wrapper", "gyoza wrapper", "puff pastry", "phyllo", "filo", "baking powder",
    ),
    "nut": (
        "almond", "cashew", "walnut", "pecan", "pistachio", "hazelnut", "macadamia", "brazil nut", "pine nut", "chestnut", "peanut", "peanut butter", "mixed nut", "nut",
        "almond flour", "almond meal", "almond milk", "cashew cream", "cashew milk", "walnut oil", "hazelnut oil", "praline", "marzipan", "nougat", "nutella", "tahini",
    ),
}
# Words of the ten flags of ``ten``.
TEN = {
    "meat": (
        "beef", "chicken", "pork", "lamb", "turkey", "veal", "duck", "venison", "bison", "bacon", "ham", "sausage", "salami", "pepperoni", "prosciutto", "pancetta", "lard", "gelatin", "anchovies", "anchovie",
    ),
    "fish": (
        "salmon", "tuna", "cod", "halibut", "tilapia", "sardine", "herring", "mackerel", "trout", "bass", "snapper", "mahi", "catfish", "crab", "shrimp", "lobster", "scallop", "oyster", "clam", "mussel",
        "squid", "octopus", "fish", "seafood",
    ),
    "dairy": (
        "milk", "butter", "cream", "cheese", "yogurt", "yoghurt", "ghee", "whey", "lactose", "casein", "mozzarella", "parmesan", "cheddar", "brie", "feta", "ricotta", "mascarpone", "crème fraîche",
        "creme fraiche", "ice cream",
    ),
    "egg": ("egg", "eggs", "mayonnaise", "mayo"),
    "gluten": (
        "flour", "wheat", "barley", "rye", "bread", "pasta", "noodle", "couscous", "semolina", "bulgur", "spelt", "kamut", "farro", "triticale", "malt", "breadcrumb", "panko", "soy sauce", "beer",
    ),
    "nut": ("almond", "walnut", "pecan", "cashew", "pistachio", "hazelnut", "macadamia", "pine nut", "peanut", "chestnut", "brazil nut", "nut", "nutmeg"),
    "pork": ("pork", "bacon", "ham", "lard", "prosciutto", "pancetta", "salami", "sausage", "pepperoni"),
    "shellfish": ("shrimp", "crab", "lobster", "scallop", "oyster", "clam", "mussel", "prawn"),
    "alcohol": ("wine", "beer", "rum", "vodka", "whiskey", "whisky", "brandy", "liqueur", "spirits", "bourbon", "sake", "mirin"),
}


def _set(hit, swappable: Column) -> dict[str, Column]:
    """The twelve flags. ``swappable``: whether all that has gluten can be had without."""
    flesh, sea = hit("meat") | hit("poultry"), hit("fish") | hit("shellfish")
    vegetarian = ~(flesh | sea)
    vegan = vegetarian & ~hit("dairy") & ~hit("egg") & ~hit("honey")
    return {
        "is_vegetarian": vegetarian,
        "is_vegan": vegan,
        "is_pescatarian_ok": ~flesh,
        "is_dairy_free": ~hit("dairy"),
        "is_gluten_free": ~hit("gluten"),
        "is_nut_free": ~hit("nut"),
        "is_halal_ok": ~hit("pork") & ~hit("alcohol"),
        "contains_pork": hit("pork"),
        "contains_shellfish": hit("shellfish"),
        "contains_alcohol": hit("alcohol"),
        "vegan_if_substituted": vegetarian & ~vegan,
        "gluten_free_if_substituted": hit("gluten") & swappable,
    }


NEGATIVE = ("contains_pork", "contains_shellfish", "contains_alcohol")


def _struct(flags: Mapping[str, Column], only: Sequence[str] | None = None) -> Column:
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items() if only is None or k in only])


def _by_term(terms: Column, hits, categories: Mapping[str, Sequence[str]], only: Sequence[str] | None) -> Column:
    """Each distinct term is looked at once, since a repeated one changes no flag, and all of them in one string of a line a term."""
    some = F.array_distinct(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    swappable = F.forall(some, lambda x: ~F.coalesce(hits(x, categories["gluten"]), F.lit(False)) | hits(x, categories["swappable"]))
    lines = F.array_join(some, "\n")
    return _struct(_set(lambda k: hits(lines, categories[k]), swappable), only)


def by_word(terms: Column, categories: Mapping[str, Sequence[str]] = CATEGORIES, only: Sequence[str] | None = None) -> Column:
    """A term hits a category by whole word. Without terms all positive flags are true. ``only`` names the flags to make."""
    return _by_term(terms, text.word_any, categories, only)


def by_substring(terms: Column, categories: Mapping[str, Sequence[str]] = CATEGORIES, only: Sequence[str] | None = None) -> Column:
    """A term hits a category by plain substring. ``only`` names the flags to make."""
    return _by_term(terms, text.contains_any, categories, only)


def mixed(terms: Column, title: Column, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> Column:
    """Single words by boundary and phrases as substrings in all text; positive flags need some term."""
    all_text = F.lower(F.concat_ws(" ", F.array_join(terms, " "), title))
    hit = lambda k: text.phrase_any(all_text, categories[k])
    some = F.coalesce(F.size(terms) > 0, F.lit(False))
    return _struct({k: c if k in NEGATIVE else c & some for k, c in _set(hit, hit("swappable")).items()})


def seven(terms: Column, title: Column, words: Mapping[str, Sequence[str]] = SEVEN) -> Column:
    """Seven flags with lists of their own, over all terms and the title: single words by boundary, phrases as substrings.

    Without terms no positive flag is set, whatever the title says.
    """
    all_text = F.lower(F.concat_ws(" ", F.array_join(terms, " "), title))
    hit = lambda k: text.phrase_any(all_text, words[k])
    some = F.coalesce(F.size(terms) > 0, F.lit(False))
    vegetarian = some & ~hit("meat") & ~hit("seafood")
    made = {
        "is_vegetarian": vegetarian,
        "is_vegan": vegetarian & ~hit("dairy") & ~hit("egg"),
        "is_gluten_free": some & ~hit("gluten"),
        "is_dairy_free": some & ~hit("dairy"),
        "is_nut_free": some & ~hit("nut"),
        "contains_shellfish": hit("shellfish"),
        "contains_nuts": hit("nut"),
    }
    return _struct(made)


def ten(terms: Column, words: Mapping[str, Sequence[str]] = TEN) -> Column:
    """Ten flags with lists of their own, by plain substring of a term: ``nut`` is in ``coconut``, ``ham`` in ``graham``.

    Without terms nothing is found. A prawn is shellfish but no fish here, so it leaves a dish vegetarian.
    """
    lines = F.array_join(F.array_distinct(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.trim(F.lower(x)))), "\n")
    hit = lambda k: text.contains_any(lines, words[k])
    vegetarian = ~hit("meat") & ~hit("fish")
    made = {
        "is_vegan": vegetarian & ~hit("dairy") & ~hit("egg"),
        "is_vegetarian": vegetarian,
        "is_pescatarian_ok": ~hit("meat"),
        "is_dairy_free": ~hit("dairy"),
        "is_gluten_free": ~hit("gluten"),
        "is_nut_free": ~hit("nut"),
        "is_halal_ok": ~hit("pork") & ~hit("alcohol"),
        "contains_pork": hit("pork"),
        "contains_shellfish": hit("shellfish"),
        "contains_alcohol": hit("alcohol"),
    }
    return _struct(made)


def tags(flags: Column, names: Mapping[str, str]) -> Column:
    """The tags of those flags that are true, in the mapping's order."""
    return F.array_compact(F.array(*[F.when(flags[k], F.lit(tag)) for k, tag in names.items()]))

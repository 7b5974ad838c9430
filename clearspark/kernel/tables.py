"""Fixed values of the rules: word lists, look-alike letters, emoji. Each must be as it is for right results."""

from __future__ import annotations

#: Well-known misspellings.
MISSPELT = {
    "teh": "the", "adn": "and", "taht": "that", "wiht": "with", "thier": "their", "recieve": "receive",
    "recieved": "received", "definately": "definitely", "definitly": "definitely", "seperate": "separate",
    "seperately": "separately", "untill": "until", "wich": "which", "becuase": "because",
    "beacuse": "because", "beleive": "believe", "belive": "believe", "goverment": "government",
    "tommorow": "tomorrow", "tommorrow": "tomorrow", "tomorow": "tomorrow", "begining": "beginning",
    "diffrent": "different", "freind": "friend", "realy": "really", "adress": "address",
    "buisness": "business", "bussiness": "business", "calender": "calendar", "neccessary": "necessary",
    "necesary": "necessary", "occured": "occurred", "occurence": "occurrence", "wierd": "weird",
    "accomodate": "accommodate", "acheive": "achieve", "accross": "across", "agressive": "aggressive",
    "apparantly": "apparently", "arguement": "argument", "basicly": "basically", "collegue": "colleague",
    "comming": "coming", "commited": "committed", "concious": "conscious", "embarass": "embarrass",
    "enviroment": "environment", "existance": "existence", "familar": "familiar", "finaly": "finally",
    "foriegn": "foreign", "fourty": "forty", "gaurd": "guard", "grammer": "grammar", "happend": "happened",
    "harrass": "harass", "immediatly": "immediately", "independant": "independent", "knowlege": "knowledge",
    "liason": "liaison", "libary": "library", "lisence": "license", "maintainance": "maintenance",
    "noticable": "noticeable", "occassion": "occasion", "paralell": "parallel", "persistant": "persistent",
    "posession": "possession", "prefered": "preferred", "privelege": "privilege", "probaly": "probably",
    "publically": "publicly", "reccomend": "recommend", "recomend": "recommend", "refered": "referred",
    "relevent": "relevant", "rember": "remember", "remeber": "remember", "resistence": "resistance",
    "succesful": "successful", "successfull": "successful", "suprise": "surprise", "tendancy": "tendency",
    "therefor": "therefore", "threshhold": "threshold", "truely": "truly", "unfortunatly": "unfortunately",
    "usefull": "useful", "writting": "writing", "alot": "a lot", "aswell": "as well", "pasword": "password",
    "acount": "account", "adresses": "addresses", "congradulations": "congratulations", "garantee": "guarantee",
    "guarentee": "guarantee", "payed": "paid", "recieving": "receiving", "sucess": "success",
    "wether": "whether", "whith": "with", "woudl": "would", "shoudl": "should", "coudl": "could",
    "dont": "don't", "didnt": "didn't", "doesnt": "doesn't", "cant": "can't", "wont": "won't", "isnt": "isn't",
    "wasnt": "wasn't", "couldnt": "couldn't", "wouldnt": "wouldn't", "shouldnt": "shouldn't", "im": "I'm",
    "ive": "I've", "thats": "that's", "youre": "you're", "theres": "there's", "whats": "what's",
    "hes": "he's", "shes": "she's", "arent": "aren't", "werent": "weren't", "havent": "haven't",
    "hasnt": "hasn't",
}
#: Listed forms that are words too.
MISSPELT_WORDS = frozenset("cant wont im dont".split())
#: Endings of regular forms and what stands there in the listed word.
ENDINGS = (("ies", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("ly", ""), ("er", ""), ("er", "e"), ("est", ""), ("ness", ""), ("ise", "ize"), ("ised", "ized"), ("isation", "ization"))

#: Shorthand with one usual meaning.
SHORTHAND = {
    "ur": "your", "l8r": "later", "gr8": "great", "b4": "before", "pls": "please", "plz": "please",
    "thx": "thanks", "thnx": "thanks", "tnx": "thanks", "tmrw": "tomorrow", "2moro": "tomorrow",
    "2morrow": "tomorrow", "2mrw": "tomorrow", "2nite": "tonight", "2day": "today", "ppl": "people",
    "cuz": "because", "coz": "because", "msg": "message", "txt": "text", "abt": "about", "tho": "though",
    "thru": "through", "luv": "love", "nite": "night", "sum1": "someone", "some1": "someone",
    "any1": "anyone", "every1": "everyone", "evry1": "everyone", "4ever": "forever", "w8": "wait",
    "m8": "mate", "wknd": "weekend", "bday": "birthday", "u": "you", "wat": "what",
    "wot": "what", "frm": "from", "jst": "just", "gd": "good", "rly": "really", "2gether": "together",
    "4get": "forget", "4got": "forgot", "h8": "hate", "sry": "sorry", "bcoz": "because", "wud": "would",
    "cud": "could", "shud": "should", "enuf": "enough",
}
#: Read in capitals only; read beside these words; read as a word before these.
SHORTHAND_CAPITALS = {"ty": "thank you"}
SHORTHAND_BESIDE = {
    "r": ("are", frozenset("u you y we they there how where what who why ur".split())),
    "c": ("see", frozenset("u you ya i".split())),
}
SHORTHAND_NUMBERS = {
    "4": ("for", frozenset("u you me my ur your the a him her us them us this that it ever".split())),
    "2": ("to", frozenset("u you me my ur your the him her us them this it b be c see go come do get say tell call ask have make know meet".split())),
}
COUNTED = frozenset("min hr hour day week month year more less other others each per of or and to in pm am am. x times people men women children percent million billion thousand hundred dozen".split())

#: Emoji that stand for a word.
EMOJI = {
    "❤": "love", "♥": "love", "🔥": "fire", "💰": "money", "💵": "money", "📱": "phone", "📞": "phone",
    "☎": "phone", "📧": "email", "✉": "letter", "🏠": "house", "🏡": "house", "🚗": "car", "🎁": "gift",
    "🔑": "key", "🌍": "world", "🌎": "world", "☀": "sun", "🌙": "moon", "⭐": "star", "🐶": "dog",
    "🐕": "dog", "🐱": "cat", "🐈": "cat", "📖": "book", "📚": "books", "💻": "computer", "🎂": "birthday",
    "🍰": "cake", "💊": "medicine", "☕": "coffee", "🍕": "pizza", "🍺": "beer", "🍷": "wine", "🏦": "bank",
    "👀": "eyes", "🎵": "music", "🎶": "music", "🌧": "rain", "❄": "snow", "🌳": "tree", "🌸": "flower",
    "🌹": "rose", "🐟": "fish", "🐦": "bird", "🐴": "horse", "👑": "crown", "🏫": "school", "🏥": "hospital",
    "✈": "plane", "🚆": "train", "🚢": "ship", "🚌": "bus", "💧": "water", "👶": "baby", "📷": "camera",
    "⚽": "football", "🎮": "game", "💡": "idea", "⏰": "time", "🍎": "apple", "💍": "ring", "🔒": "lock",
}
#: Words after which an emoji is the noun.
EMOJI_LEADS = frozenset("a an the my your our his her their this that some no any of for with to in on at by and or happy good new big little old free more".split())

#: Digits and signs that look like letters, and what may follow a number.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
UNITS = frozenset("st nd rd th s am pm k m g h d x b bn kg km cm mm ml mg px ms hr hrs min mins sec gb mb kb tb hz mph up".split())

#: Invisible characters, and symbols that stand for a letter inside a word.
INVISIBLE = "​‌‍⁠﻿­᠎⁡⁢⁣⁤"
LETTER_SIGNS = {"¢": "c", "₫": "d", "∨": "v", "¡": "i"}
#: Letters that look only roughly like a plain one.
ROUGHLY_ALIKE = {
    "τ": "t", "η": "n", "κ": "k", "ᴨ": "n", "ң": "h", "п": "n", "ʍ": "m", "β": "b", "ŉ": "n", "ҥ": "h", "к": "k",
    "ω": "w", "ĸ": "k", "Ƿ": "p", "щ": "w", "ᚱ": "r", "ժ": "d", "в": "b", "μ": "u", "н": "h", "Ի": "r", "қ": "k",
    "џ": "u", "Ա": "u", "м": "m", "т": "t", "г": "r", "ш": "w", "ρ": "p", "ν": "v", "χ": "x", "ε": "e", "σ": "o",
    "ᴦ": "r",
}
#: Letters with several readings, tried in order.
SEVERAL_READINGS = {
    "þ": "pb", "ϸ": "pb", "ɕ": "cg", "ө": "eo", "ԑ": "se", "ғ": "fr", "ſ": "fs", "ϱ": "pe",
    "ƅ": "b", "ϝ": "f", "ϵ": "e", "ς": "c", "ϛ": "c", "ɥ": "u", "ʘ": "o", "µ": "u",
    "ե": "t", "ր": "n", "թ": "p", "և": "u", "Ւ": "t", "υ": "uv",
}
#: Look-alikes that are used when no table is given: Greek and Cyrillic letters that look like a plain one.
#: The whole table of Unicode's confusable letters is an input (see sources.lookalikes).
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "l", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԍ": "G",
    "α": "a", "ι": "i", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "γ": "y", "σ": "o", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "l", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
}

#: Blocks of combining marks, decorated alphabets, letter-like signs, full-width forms.
MARK_BLOCKS = ((0x0300, 0x036F), (0x0483, 0x0489), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
STYLED_BLOCKS = ((0x1D400, 0x1D7FF), (0x24B6, 0x24E9), (0x1F130, 0x1F149))
LETTERLIKE_BLOCK = (0x2100, 0x214F)
FULLWIDTH_BLOCK = (0xFF01, 0xFF5E)
#: Element names by which a text counts as HTML source.
HTML_NAMES = "a b i u p br hr div span img html head body title meta link script style table tr td th ul ol li h[1-6] em strong code pre form input button label select option iframe svg font center small sup sub".split()

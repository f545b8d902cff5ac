"""Lexicon and pattern voters on passages: for abuse (+1), against it (-1), or silent (0)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from re import _constants as sre
from re import _parser as parser

from kernwerk.llm.textnorm import plain

# Word lists of the voters, in lower case without accents.
INSULTS = (
    "idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits dimwit dimwits dumbass dumbasses jackass asshole assholes arsehole bastard bastards prick pricks dipshit shithead shitheads loser losers scumbag scumbags dickhead twat wanker "
    "bitch bitches slut sluts whore whores cunt cunts retard retards fuckwit fucker fuckers motherfucker dumbfuck bonehead numbskull nitwit simpleton degenerate scum creep lowlife douchebag shitbag pissant "
    "vollidiot schwachkopf drecksack arschloch wichser dummkopf trottel hurensohn missgeburt spast "
    "abruti connard connasse salaud salope raclure ordure encule cretine idiote conne "
    "idiota idiotas imbecil imbeciles cerdo cerda gilipollas cabron pendejo estupido puta malparido"
).split()
ADJECTIVES = "worthless pathetic stupid clueless brainless filthy disgusting miserable ugly useless lying cheating drunken dumb vile spineless rotten elender elende dummer dumme widerlicher widerliche bloder blode pauvre sale inutil asqueroso asquerosa".split()
PROFANITY = "fuck fucks fucked fucking fucker shit shitty bullshit goddamn mierda gueule fresse putain scheisse merde joder cunt cock cocks dick dicks pussy tits horny xxx porn porno cum slutty blowjob boobs nude nudes naked erection".split()
DEHUMANISED = "vermin rats rat filth subhuman subhumans savages savage animals disease parasites parasite cockroaches lice maggots plague cancer scum garbage trash ungeziefer abschaum untermenschen basura escoria ratas vermine racaille raclures cafards ordures nuisibles animaux animales parasitos plaga ratten parasiten tiere beasts pigs dogs leeches".split()
PERSONS = "you u ya youre yourself yourselves yours your ur yall du dich dir dein deine tu te toi ton ta tes vous votre eres tus ti te os".split()
HARM = "kill murder stab shoot strangle choke drown hang burn smash break snap crush beat batter hurt harm maim slit slash cut carve gut skin bury hunt rape bludgeon poison destroy bleed torture punch kick hit run finish".split()
HARM_ABROAD = "umbringen toten erschlagen abstechen verprugeln kaltmachen fertigmachen tuer crever buter frapper egorger massacrer bruler matar matarte romper romperte golpearte quemarte destrozarte".split()
WEAPONS = "gun knife hammer axe bat rope rifle shotgun machete blade pistol revolver crowbar razor sword bomb petrol gasoline".split()
REMAINS = "body corpse grave funeral coffin blood bones skull throat neck jaw teeth face legs fingers guts ashes remains cadaver wake obituary".split()
SURVIVE = "live survive breathe wake walk escape make last see reach".split()
REMOVED = "driven locked caged kicked exterminated deported wiped gassed burned burnt hanged hung killed sterilised sterilized expelled thrown drowned shot starved culled whipped banned rounded got gotten put kept chased removed eliminated eradicated cleansed beaten shipped sent chained jailed crushed".split()
REMOVED_ABROAD = "ausgerottet verjagt vergast weggesperrt abgeschoben vernichtet exterminer chasser bruler expulser exterminados expulsados expulsarlos matarlos echarlos quemarlos".split()
CRIMINALS = "liars thieves criminals killers cheats beggars rapists murderers crooks swindlers terrorists robbers parasites".split()
SEX_PARTS = "cock cocks dick dicks penis erection pussy cunt clit nipples nipple tits boobs breasts breast thighs thigh ass arse member groin crotch buttocks".split()
SEX_ACTS = "sucked sucks sucking licked licking fucked fucks fucking screwed straddled fingered banged groped fondled penetrated thrust thrusting moaned moaning moans groaned throbbed throbbing swelled swelling hardened stiffened dripped dripping orgasm climaxed ejaculated masturbated masturbating undressed stripped spreading touching stroked stroking riding rode".split()
SEX_TRADE = "horny nude nudes naked xxx porn porno pornography sexy hookup escorts escort webcam milf milfs slutty kinky topless uncensored".split()
LURES = "watch click join meet chat call stream download register signup free live tonight near nearby online photos pics pictures videos video clips cams girls women ladies men boys singles housewives teens local now hot".split()
AGENCY = "must should ought deserve deserves need moved called came come arrived want wants took take steal live vote breed crawl crawled swarm flooded invaded demand demanded asked".split()
_I, _A, _D, _YOU, _HARM = ("|".join(x) for x in (INSULTS, ADJECTIVES, DEHUMANISED, PERSONS, HARM))
_WILL = "will|ll|going|gonna|shall|want|wanna|am|im|ill|are|were|theyll|coming|come|ready"

#: name -> pattern over " word word … ". Each pattern is one voter for abuse; all are made of general lists and a little syntax.
POSITIVE = {
    "addressed_insult": rf" (?:{_YOU}|tus|nes|bist|eres) (?:\w+ ){{0,5}}(?:{_I}) ",
    "insult_for_you": rf" (?:{_I}) (?:\w+ ){{0,2}}(?:like|as) (?:you|u|ya|yours) ",
    "told_off": r" (?:(?:fuck|piss|bugger|sod|naff) (?:you|off|ya|u)|shut (?:the \w+ )?up|get lost|go to hell|rot in hell|drop dead|screw you|stfu|ta gueule|va te faire|degage|casse toi|halt die fresse|halt die klappe|halts maul|verpiss dich|fahr zur holle|vete a la|vete al|callate|do us all a favou?r|learn to (?:read|think|spell|write|shut)|delete your account) ",
    "self_harm": rf" (?:(?:{_HARM}) (?:yourself|yourselves|urself|your self|ur self)|go (?:and )?die|tuez? toi|matate|muerete|creve donc|bring dich um|hang dich auf|end (?:your|ur) life|neck yourself|take your own life) ",
    "unwanted": r" (?:without (?:you|u|ya|your (?:kind|sort|type|lot)|people like you|the likes of you)|waste of (?:\w+ ){0,2}(?:skin|space|air|oxygen|breath|food|time|life)|no ?(?:body|one) (?:\w+ )?(?:cares|asked|likes|loves|wants|needs|misses|invited|believes|trusts|respects) (?:\w+ ){0,8}(?:you|u|yours)|(?:person|people|man|men|woman|women|child|failure|thing|creature|animal|something|someone|somebody|nothing|those|anyone) (?:\w+ )?like (?:you|u|ya)|(?:should|must|ought to|can|could|may) (?:not|never) be (?:\w+ )?(?:let|allowed|trusted|permitted|left)|never be (?:let|allowed|trusted|permitted|left)|never have been born) ",
    "compared": r" (?:(?:as|like|than) (?:yours|urs|you) (?:\w+ )?(?:is|are|should|must|ought|could|can|would|will|has|have|never|deserve|deserves|belong|belongs)|(?:mind|head|brain|face|skull|iq|mouth|soul) (?:\w+ ){0,2}(?:as|like) (?:yours|urs|you|u)|(?:it is|its|what) an? (?:surprise|wonder|miracle|mystery|pity|shame|tragedy|disgrace) (?:\w+ ){0,3}(?:you|u)) ",
    "family_shamed": r" (?:your|ur|his|her|their) (?:mother|father|family|parents|brother|sister|children|wife|husband|teachers?) (?:\w+ ){0,4}(?:ashamed|shame|regret|regrets|cry|weep|disown|embarrassed|disappointed|sorry|sick) ",
    "belittled": r" (?:scraped|wiped|stepped|flushed|washed|picked|scratched|spat|coughed|trodden|found|seen|met) (?:\w+ )?(?:better|smarter|nicer|cleverer|brighter|wiser|prettier|funnier) (?:\w+ ){0,3}(?:off|in|on|out|under|from|than) ",
    "mocked": rf" (?:(?:another|typical|such an?|what an?|just an?|like an?|only an?|only some|some|every|this|that) (?:(?:{_A}) )*(?:{_I})|(?:is|are|was|be) (?:such |just |nothing but )?an? (?:(?:{_A}) )*(?:{_I})|(?:{_A}) (?:{_I})) ",
    "threat": rf" (?:i|we|ill|im|id|were|well|theyll|they|someone|people) (?:\w+ ){{0,3}}(?:{_WILL}) (?:\w+ ){{0,4}}(?:{_HARM}|put|make|drag|throw|dump|find) (?:\w+ ){{0,2}}(?:you|your|u|ur|ya|him|her|them|his|their) ",
    "threat_abroad": rf" (?:ich (?:bringe?|mache?|schlage?|steche?|werde|hau|will) (?:\w+ ){{0,2}}(?:dich|euch|dir)|je (?:vais|veux) (?:te|vous|tous) \w+|(?:te voy a|os voy a|voy a|vamos a) \w+|(?:{'|'.join(HARM_ABROAD)})) ",
    "doomed": rf" (?:you|u|ya) (?:wont|will not|will never|will soon|shall not|dont|do not|cannot|cant|are not going to|will not even) (?:\w+ )?(?:{'|'.join(SURVIVE)}) ",
    "remains": rf" (?:find|bury|dump|burn|break|cut|slit|smash|snap|spill|dig|cover|carry|attend|dance|spit|piss|visit|identify|drain|fill|come|laugh|until|crack|wash) (?:\w+ ){{0,3}}(?:your|ur|his|her|their|the) (?:{'|'.join(REMAINS)}) ",
    "stalked": r" (?:(?:i|we) know (?:\w+ ){0,1}(?:where|which|when|what) (?:\w+ ){0,2}(?:you|your|u|ur|he|she|they)|(?:i|we) know (?:your|ur) (?:address|house|home|street|school|route|car|name)|(?:watch|mind|guard) (?:your|ur) (?:back|step|family|neck)|lock (?:your|ur) (?:doors?|windows?)|sleep (?:lightly|with one)|say (?:your|ur) prayers|count (?:your|ur) days|(?:youre|you are|ur) (?:dead|finished|next)|your (?:house|home|family|car) (?:will|is going to|shall) (?:burn|die|bleed|suffer)) ",
    "armed": rf" (?:be|am|are|waiting|there|coming|come|bring|bringing|got|have|stand|standing|outside) (?:\w+ ){{0,3}}(?:a|an|my|our) (?:{'|'.join(WEAPONS)}) ",
    "dehumanised": rf" (?:(?:are|is|sind|son|sont|bunch of|nothing but|like) (?:a |an |all |only |just |nothing but |such |the |filthy |worse than )*(?:{_D})|(?:the|these|those|such|all|when|diese|esos|ces) (?:\w+ ){{0,1}}(?:{_D}) (?:\w+ )?(?:{'|'.join(AGENCY)})|(?:barely|hardly|scarcely|not|not even|never) (?:really )?human|not even (?:people|human)|(?:lower|worse|less|dirtier|dumber) than (?:dogs?|animals?|rats?|pigs?|human|humans|beasts?|vermin|dirt)|(?:race|kind|people|sort|tribe|breed|folk) (?:has|have|had) no (?:soul|honour|honor|shame|culture|heart|brain)) ",
    "removed": rf" (?:(?:must|should|ought to|have to|need to|deserve to|needs to) (?:all |just |simply )?be (?:{'|'.join(REMOVED)})|(?:should|ought to|must) have (?:been )?(?:all )?(?:{'|'.join(REMOVED)}|finished)|(?:{'|'.join(REMOVED_ABROAD)})|(?:keep|throw|kick|drive|send|get|kept) (?:\w+ ){{1,4}}(?:out|back) they|send them back|kill them all) ",
    "stereotyped": rf" (?:breeds? like|(?:steals?|ruins?|dirt(?:y|ies)|takes?|destroys?|grabs?) (?:all|everything|anything|whatever) (?:they|he|she|it)|stinks? (?:worse|like|of)|(?:never|dont|do not) (?:wash|work|bathe)|spreads? (?:disease|diseases|filth|lies)|(?:{'|'.join(CRIMINALS)}) by (?:nature|blood|birth|heart)|(?:born|all|natural|typical|filthy) (?:{'|'.join(CRIMINALS)})|never (?:trust|hire|marry|help|believe|lend|employ|befriend|feed) (?:a|an|any|these|those|the)|(?:hide|count|guard|watch|hold) (?:your|ur) (?:purse|fingers|wallet|pockets?|money|silver|children|daughters?|women)|live next door (?:they|to)|(?:no|any) (?:decent|sane|honest|normal|proper) (?:family|person|man|woman|people|town|country) (?:\w+ )?would|(?:problem|problems|illness|crime|crimes|theft|thefts|fire|ill|misery|evil|trouble|disease) (?:\w+ ){{0,5}}(?:started|began|begins|starts|came|comes) (?:when|with|from|because)) ",
    "explicit": rf" (?:(?:{'|'.join(SEX_PARTS)}) (?:\w+ ){{0,2}}(?:{'|'.join(SEX_ACTS)})|(?:{'|'.join(SEX_ACTS)}) (?:\w+ ){{0,3}}(?:{'|'.join(SEX_PARTS)})|(?:sucked|licked|fucked|screwed|straddled|banged|fingered|pounded|groped|penetrated) (?:him|her|me|us|them|each|you)|between (?:his|her|my|your|their) (?:thighs|legs)|until (?:he|she|i|they|we) (?:came|climaxed)|begged (?:\w+ )?(?:to|for|her|him|me) (?:\w+ )?(?:go|be|fuck|take|more|harder|deeper)|beg for it|(?:he|she|they|i|we) (?:\w+ ){{0,3}}(?:fucked|screwed|moaning|moaned)|(?:undressed|naked) and (?:sweating|moaning|wet|panting|ready)|undid (?:his|her|my) (?:belt|bra|blouse|trousers|zip|fly|shirt|jeans)|(?:wet|hard|horny|hot) for (?:you|me|him|her|it)|(?:want|wants|wanna|love|loves|dying) to (?:fuck|suck|ride|lick)) ",
    "sex_trade": rf" (?:(?:{'|'.join(LURES)}) (?:\w+ ){{0,4}}(?:{'|'.join(SEX_TRADE)})|(?:{'|'.join(SEX_TRADE)}) (?:\w+ ){{0,4}}(?:{'|'.join(LURES)})|(?:picture|pictures|photo|photos|video|videos|pics|pic) of (?:your|ur|her|his|my) (?:\w+ )?(?:{'|'.join(SEX_PARTS)})|(?:send|show|showing) (?:\w+ ){{0,3}}(?:{'|'.join(SEX_PARTS)}|nudes|nude|naked)) ",
    "insult_word": rf" (?:{_I}) ",
    "profanity": rf" (?:{'|'.join(PROFANITY)}) ",
    "harsh_you": rf" (?:{_YOU}) (?:\w+ ){{0,4}}(?:{_A}) ",
}
#: Voters against abuse: sober mention in dictionaries, history, medicine, nature and technology, and harmless swearing at things. General lists.
NEGATIVE = {
    "lexical": r" (?:noun|verb|adjective|adverb|dated|obsolete|archaic|synonyms?|etymology|formerly|meaning|means|meant|the word|the term|a term|slang|heraldry|dictionary|definition|defined|derogatory|pejorative|spelling|plural|translated|wedlock|pronounced) ",
    "reported": r" (?:moderators?|moderation|removed a post|historians?|propaganda|pamphlets?|slandered|court|sentenced|police|convicted|ballad|novel|film|play|song|poem|murdered|crime|researchers|survey|policy|guidelines|reported|century|law|newspaper|trial|jury|final|match|season|tournament|league|championship) ",
    "quoted": rf" (?:called|calls|calling|named|labelled|described) (?:\w+ ){{1,3}}(?:a|an) (?:\w+ )?(?:{_I}) | (?:the|a) (?:word|insult|slur|term|phrase) (?:{_I}) ",
    "medical": r" (?:infections?|condoms?|provider|examination|vagina|vaginal|penile|cervical|breast(?:feeding|fed)?|symptoms?|sexually transmitted|patients?|clinic|doctor|nurse|hospital|treatment|tablets?|dose|pregnan\w+|screening|cancer|biopsy|test) ",
    "nature": r" (?:bird|birds|beetle|beetles|hen|hens|rooster|donkey|donkeys|pups|puppies|calf|foal|nest|nests|nesting|prey|species|male|males|female|females|mates|mating|mounts|dawn|feathers|wings|eggs|larvae|breeds? in|flowers|seeds?|oil|crop|crops|harvest|forest|river|marsh|shore|nursed|sow|ewe|cocktail|recipe) ",
    "technical": r" (?:process|processes|parent|orphaned|children with|daemon|command|shell|script|mount|wire|terminal|ports?|penetration|plate|server|thread|screw|bolt|circuit|voltage|kernel|log|file|files|directory|socket|jack|plug|connector|pipe|valve) ",
    "about_things": r" (?:(?:silly|stupid|damn|bloody|wretched) \w+ of (?:mine|ours)|of mine is|damn it|stupidly \w+) ",
}
#: Voters that speak on a word or a loose shape alone, and so are right less often.
WEAK = frozenset(("compared", "insult_word", "profanity", "harsh_you", "armed", "remains", "unwanted", "stereotyped"))
NAMES = [*POSITIVE, *NEGATIVE]
_FOR, _AGAINST = [re.compile(p) for p in POSITIVE.values()], [re.compile(p) for p in NEGATIVE.values()]
#: Words that the gate prefers to look for; what they leave open, ``_gate`` adds.
_PREFERRED = frozenset(INSULTS + ADJECTIVES + PROFANITY + DEHUMANISED + HARM + HARM_ABROAD + WEAPONS + REMAINS + REMOVED_ABROAD + CRIMINALS + SEX_PARTS + SEX_ACTS + SEX_TRADE)
_ANY = "\0"  #: stands for \\w in a wording
_COMMON = frozenset("a an the all and are as at be by de du es he i in is it la les like me my no of off on or out she that they this to too tous und up we when who you your youre ur must should ought need have has had for will than not which where would what when like from find get take put make know want those these some that one so do did people thing something man men woman women life fire without".split())


def wordings(tree: parser.SubPattern) -> list[str]:
    """Every string that a pattern matches, with _ANY for any word character and each unbounded or word-wise repetition at its least."""
    out = [""]
    for op, arg in tree:
        if op is sre.LITERAL:
            more = [chr(arg)]
        elif op is sre.IN:
            more = [chr(v) if k is sre.LITERAL else _ANY for k, v in arg]
            if any(k is not sre.LITERAL and (k, v) != (sre.CATEGORY, sre.CATEGORY_WORD) for k, v in arg):
                raise ValueError(f"no wording for {arg}")
        elif op is sre.BRANCH:
            more = [w for part in arg[1] for w in wordings(part)]
        elif op is sre.SUBPATTERN:
            more = wordings(arg[3])
        elif op is sre.MAX_REPEAT:
            least, most, part = arg
            body = wordings(part)
            if (least, most) == (0, 1):
                more = ["", *body]
            elif all(w == _ANY or w[0] == " " or w[-1] == " " for w in body):  # whole words: a longer match has all words of the shortest
                more = ["".join(c) for c in product(body, repeat=least)]
            else:
                raise ValueError(f"a repetition within a word: {body[:3]}")
        else:
            raise ValueError(f"no wording for {op}")
        out = [a + b for a in out for b in more]
    return out


def _gate(pattern: str) -> set[str]:
    """Words of which every wording of a pattern has at least one: those of the lists above where there are any, else its longest uncommon one."""
    got: set[str] = set()
    for wording in wordings(parser.parse(pattern)):
        words = [w for w in wording.split() if _ANY not in w]
        if got.isdisjoint(words):
            got.add(max(words, key=lambda w: (w in _PREFERRED, w not in _COMMON, len(w), w)))  # raises where a wording has no fixed word
    return got


#: For each word the voters for abuse that cannot speak without it or another such word, as bits; derived from the patterns.
_OPENS: dict[str, int] = {}
for _i, _p in enumerate(POSITIVE.values()):
    for _w in _gate(_p):
        _OPENS[_w] = _OPENS.get(_w, 0) | 1 << _i
#: Words without which no voter for abuse speaks; a passage without any is silent.
TRIGGERS = frozenset(_OPENS)

_LEET = str.maketrans("013457$@!|€+", "oieastsaiiet")
_SPACED = re.compile(r"^[^\w$@]*([a-z0-9$@!])((?:[.\-_·•*/ ][a-z0-9$@!]){2,})[^\w]*$")
_MASKED = re.compile(r"[a-z]\*+[a-z]*|[a-z]+\*+")
_EDGE = re.compile(r"^[^\w$@*]+|[^\w$@*]+$")
_RUN = re.compile(r"(.)\1{2,}")
_NOT = re.compile(r"[^a-z]+")
_KNOWN = frozenset(INSULTS) | frozenset(ADJECTIVES) | frozenset(PROFANITY) | frozenset(DEHUMANISED) | TRIGGERS
_BY_SHAPE: dict[tuple[str, int], list[str]] = {}
for _w in sorted((frozenset(INSULTS) | frozenset(PROFANITY) | frozenset(DEHUMANISED)), key=lambda w: ([*INSULTS, *PROFANITY, *DEHUMANISED].index(w))):
    _BY_SHAPE.setdefault((_w[0], len(_w)), []).append(_w)


@lru_cache(maxsize=300_000)
def undisguised(token: str) -> str:
    """The lower-case word behind a token: leet digits, letters set apart, masked, stretched or mixed in case. '' for none."""
    t = token.lower()
    if t.isalpha() and t.isascii():
        if _RUN.search(t):
            for keep in (r"\1", r"\1\1"):
                if (w := _RUN.sub(keep, t)) in _KNOWN:
                    return w
        return t
    if m := _SPACED.match(t):
        w = _NOT.sub("", (m[1] + re.sub(r"[.\-_·•*/ ]", "", m[2])).translate(_LEET))
        if len(w) > 2:
            return w
    t = _EDGE.sub("", t)
    if "*" in t and (m := _MASKED.search(t)):
        shape = re.compile(re.sub(r"\*", "[a-z]", m[0]) + "$")
        for w in _BY_SHAPE.get((m[0][0], len(m[0])), ()):
            if shape.match(w):
                return w
    if any(c in "013457$@!|€+" for c in t) and (any(c.isalpha() for c in t) or len(t) > 3):
        for form in (t.rstrip("!|").translate(_LEET), t.rstrip("!|").replace("1", "l").translate(_LEET)):
            w = _NOT.sub("", form)
            if w in _KNOWN or _RUN.sub(r"\1", w) in _KNOWN:
                return w if w in _KNOWN else _RUN.sub(r"\1", w)
    w = _NOT.sub("", t)
    if _RUN.search(w):
        for keep in (r"\1", r"\1\1"):
            if (v := _RUN.sub(keep, w)) in _KNOWN:
                return v
    return w


def _joined(words: list[str]) -> list[str]:
    """Runs of single letters that spell a listed word become that word."""
    if len([1 for w in words if len(w) == 1]) < 3:
        return words
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and len(words[j]) == 1:
            j += 1
        for end in range(j, i + 2, -1):
            if (w := "".join(words[i:end])) in _KNOWN:
                out.append(w)
                i = end
                break
        else:
            out.append(words[i])
            i += 1
    return out


_PARAGRAPH = re.compile(r"\n\s*\n|\n\s*(?=[-*•>#|]|\d+[.)])")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
LONGEST = 60  #: words; longer sentences are read in overlapping windows


def passages(text: str | None) -> Iterator[list[str]]:
    """The undisguised words of each sentence of a text, whole; very long ones in windows that overlap by half."""
    if not text:
        return
    for paragraph in _PARAGRAPH.split(plain(text, stars=True)):
        for sentence in _SENTENCE.split(paragraph):
            got = _joined([w for t in sentence.replace("/", " ").replace("—", " ").replace("–", " ").split() if (w := undisguised(t))])
            if len(got) <= LONGEST:
                if got:
                    yield got
                continue
            for i in range(0, len(got) - LONGEST // 2, LONGEST // 2):
                yield got[i : i + LONGEST]


def votes(passage: list[str]) -> str | None:
    """One character for each voter (p, n or .), or None where all voters for abuse are silent. Only patterns that a word opens are tried."""
    if TRIGGERS.isdisjoint(passage):
        return None
    opened = 0
    for w in passage:
        opened |= _OPENS.get(w, 0)
    s = " " + " ".join(passage) + " "
    out = "".join("p" if opened >> i & 1 and p.search(s) else "." for i, p in enumerate(_FOR))
    return out + "".join("n" if p.search(s) else "." for p in _AGAINST) if "p" in out else None

"""The abuse grammar: parts that are composed to rules of insult, threat, hate and sexual content, and rules that take back.

Upper-case names in braces are labels of the lexicon or the parts defined here. Clauses are in folded lower case.
"""

from __future__ import annotations

from .fst import Node, parse

_PARTS = {
    # target: who is addressed
    "YOU": "(you|u|youre|ya|yall)",
    "YOURS": "(you|u|youre|your|yours|ya|yall)",
    "DU": "(du|ihr|dich|euch)",
    "DEGREE": "(so|too|very|such|really|just|all|utterly|completely|totally|absolutely|simply|always|still|only|a|an|the|more|most|that|clearly|obviously|truly|quite|rather|pretty|one|some|kind of|sort of|nothing but|complete|total|utter|absolute|real|big|huge|{LY})",
    "ARE": "(are|re|r|is|were|must be|will always be|will never be|look like|act like|sound like)",
    # insult
    "BAD": "({INS}|{SOFT})",
    "DEM": "({DEMEANED}|brain dead|low life|half witted|sub human)",
    "PILE": "(piece|pieces|pile|sack|bag|heap|load|bucket|lump) of ({DEMEANED}){0,2} {EXCREMENT}",
    "SAID_OF_YOU": "{YOU} {ARE} {DEGREE}{0,4} {DEM}{0,2} {DEMEANING}",
    # threat
    "WILL": "(will|ll|am going to|m going to|m gonna|gonna|am gonna|would love to|d love to|want to|wanna|would|d|ought to|should|could|shall|am about to|swear i will|swear i ll|hope to)",
    "VICTIM": "({YOU}|your {KIN}|your {PARTS_OF_YOU}|your (whole|entire) {KIN})",
    "WANTED": "(should|must|ought to|deserve to|need to|have to|can|shall)",
    # hate
    "THOSE": "(the|those|these|all|of|any|every|each|dirty|filthy|fucking|damn|last one|single one)",
    "SORT": "({GRP}|{SLUR}|(black|white|brown|asian|jewish|muslim|arab|trans|gay|disabled|gypsy|foreign|coloured|colored|indian|chinese|mexican|african) (people|men|women|folks|guys|kids|person))",
    "ALIEN": "({SORT}|{CAP})",
    # taking back
    "NO": "(not|never|no|nicht|kein|keine|pas|jamais|nunca)",
    "BE": "(are|re|is|s|was|were|am|m|be|been|bin|bist|ist|seid|sind|war|warst|suis|es|est|etes|sommes|soy|sois|son)",
    "HOW": "(so|such|really|just|also|still|always|only|even|quite|rather|pretty|now|here|all|being|been|be|like|called|indeed|too|ja|echt|wirklich|doch|auch|vraiment|tellement|trop|bien|tan|muy|realmente|{NO}|{LY}|, {FREE} {FREE}? ,)",
    "PREDICATE": "{HOW}{0,3} ((a bit of a|a bit of an|a|an|the|such a|such an|some|any|what a|what an|un|une|le|la|ein|eine|einen|der|die|una|el|kein|keine) ({FREE} (and {FREE})?)?|(complete|total|utter|real|big|stupid|useless))?",
    "INSULTS": "<{BAD} ((or|and|nor|oder|und|noch|ou|et|ni|o|y) (a|an|une|un|eine|ein|una)? {FREE}? {BAD}){0,}> {UNLIKE}",
    "SENSUAL": "({PRIVATE}|thighs|naked body|bare skin|panties|underwear|nipples|curves)",
    "SOMEBODY": "(he|she|they|someone|somebody|everyone|everybody|people|another|er|il|elle|el|ella|(the|a|an|my|our|his|her|one|another|some|der|die|le|la|un|une) {WORD}|{CAP})",
}
PARTS: dict[str, Node] = {}
for _k, _v in _PARTS.items():
    PARTS[_k] = parse(_v, PARTS)

#: (kind, weight, rules)
GRAMMAR = [
    ("abusive", 0.9, """
{YOURS} ~{0,4} {BAD}
{BAD} like you
{DU} ~{0,4} {BAD}
(tu es|t es|tes|vous etes|espece de|sale|gros|pauvre) ~{0,3} {BAD}
(eres|sois|pedazo de|maldito|puto) ~{0,3} {BAD}
(sei|siete) ~{0,3} {BAD}
hay que ser {BAD}
il faut etre ~{0,2} {BAD}
(welche|welcher|welches|was fur ein) ~{0,2} {BAD}
{BAD} detected
(shut up|get lost|quit crying|stop crying|learn to read|piss off|fuck off|go away|listen|callate|ferme ta gueule|halt die fresse|hau ab|ta gueule|degage) ~{0,3} {BAD}
(bigger|biggest|resident|complete|total|utter|other|{DEMEANED}) {BAD}
(what a|what an|what kind of|which|only a|only an|when a|when an) {BAD}
{SAID_OF_YOU}
{YOU} {DEGREE}{0,2} {DEM}{1,3} {DEMEANING}
(only|just|like|such|what) (a|an)? {DEM}{1,2} {DEMEANING} ({END}|would|could|like|who)
(pedazo de|espece de|du stuck|stuck|bout de) {EXCREMENT}
{YOU} {ARE}? {DEGREE}{0,4} ({DEMEANED}|lying|sorry|little){0,2} {PILE}
{YOU} ({DEM}|little|old|sad|sorry|lying|sneaky|silly|poor|sick|absolute|complete|total|utter){1,3} ({DEMEANING}|{BAD})
{YOU} {ARE} (by far|probably|definitely|truly|easily)? the (dumbest|stupidest|ugliest|laziest|most {DEMEANED}|biggest {DEMEANING}) {WORD}
{YOU} {ARE} the worst (person|human|human being|man|woman|developer|engineer|programmer|reviewer|excuse)
are (you|u) {DEGREE}{0,2} {DEM} (or|{END})
{YOU} (smell|stink) like
(everyone|everybody) .{0,4} hates (you|u)
(your kind|your sort|people like you|someone like you) (makes me sick|make me sick|makes us sick|make us sick|disgust|disgusts|are not welcome|aren t welcome|aren t wanted)
{YOU} {ARE}? {DEGREE}{0,4} {DEMEANED}{0,2} (excuse|waste) (for|of) a (human|person|man|woman|developer|engineer|programmer)
(what a|what an) {DEMEANED} (man|woman|person|human|human being|excuse for a .)
"""),
    ("abusive", 0.6, "{INS}\n{SLUR}"),
    ("abusive", 0.8, """
shut (up|your)
get lost
(fuck|piss|sod|bugger) off
(fuck|screw|damn) (you|u|ya|yourself)
(go to|rot in|burn in) hell
drop dead
(eat|kiss) (shit|my ass|my arse)
halt (die fresse|s maul|das maul|deine fresse|den mund)
hau (doch)? ab
verpiss (dich|euch)
fick (dich|euch)
leck mich
(ferme|fermez) (ta|la|vos) (gueule|bouche)
ta gueule
va (te faire|crever|mourir|au diable)
(nique|niquez) (ta|tes|vos)
vete a la (mierda|verga)
que te (jodan|follen)
(chinga|jodete|callate)
das asco
degage d ici
(nadie te ha preguntado|nobody asked you)
lern erst mal
(vaffanculo|kys|stfu|gtfo)
"""),
    ("abusive", 0.85, """
waste of (oxygen|space|skin|air|breath|time and oxygen)
nobody (here)? (would|will|ll) ever? miss you
(nobody|no one) (here)? (likes|loves|wants|needs) you
(more worth|worth more) than (you|your)
your brain (must|is|has)
(you|u) (have|ve got|got) (no|half a|the) (brain|brains|brain of a .|iq of a .)
crawl back (under|into|to)
(my|the|a) (dog|cat|toddler|grandmother|monkey) (writes|codes|could write|has|knows) . .? than you
your (parents|mother|father|family|mom|mum|dad) (must|should|has to|have to|ought to|will) be
never touch a (keyboard|computer)
(should not|shouldn t|shouldnt) be allowed near
do (us|me|everyone|the world|humanity) all? a (favour|favor) and (quit|leave|die|never|jump|disappear|resign|stop)
quit crying
stop wasting our time
(you|u) (disgust|sicken|repulse) (me|us|everyone)
{YOU} {ARE} {DEGREE}{0,3} (too stupid|so stupid|pathetic|worthless|disgusting|a joke|an embarrassment|a disgrace|nothing)
the world (would be|is) better off? without you
learn to read you
{YOU} (are|re) (the|a) (human|living|walking) (version|equivalent|embodiment|definition|waste) of
(useless|worthless) and (unloved|unwanted|stupid|pathetic|ugly)
{YOU} (are|re|r)? {DEGREE}{0,4} {DEM} (and .)? ({END}|that|if|when|but|for|because)
{YOU} (are|re|r)? (way|far|just)? too {DEM} to .
(how|are you|r u) (fucking|so|that|really|actually|this) {DEMEANED} {END}
(how) {DEMEANED} (are|can) (you|u)
nobody (would|will|could) ever love you
(nobody|no one) (would|will|d) (cry|care|notice|mourn) if you (got hit|get hit|died|die|were dead|disappeared|were gone)
(mother|father|parents|mom|mum) should have (swallowed|aborted|drowned|strangled) (you|u)
(play|go play) in traffic
jump in front of (a|the) (train|bus|car|truck)
(suck it|bag of dicks|choke on (it|a|my|that))
"""),
    ("abusive", 0.9, """
(i|we|someone|somebody) {WILL} .{0,2} {VIOLENCE} {VICTIM}
(i|we) {WILL} .{0,6} (strangle|kill|murder|stab|rape|slaughter|lynch|gut|choke|torture|cripple|behead|beat|hurt) (you|your {KIN})
(i|we) (ll|will) (hunt|track) (you|u|your {KIN}) down
(i|we) (ll|will) be (coming|waiting) for (you|your {KIN})
(teach you a lesson|find out where you live|know where you live|limp home|watch your back|come for you|make you pay|beat you up)
(break|smash|rearrange|punch|kick) (your|ur) {PARTS_OF_YOU}
(i|we) hope that? (you|u|he|she|they|your .? {KIN}|you and your {KIN}) all? ({SUFFER}|(get|gets|catch|catches) (hit|cancer|fired|sick|raped|shot|killed|run over|aids)|never wake)
wish (we|i|they) could still? (hit|slap|punch|beat|kick|hurt)
you ll (be sorry|regret|pay for)
(you|team|lot|all) can all? rot
(kill|hang|shoot|off|end|drown|delete|neck) (yourself|urself|yourselves)
jump off (a|the) (bridge|roof|cliff|building)
keep talking and i
if you (vanished|died|disappeared|were dead)
ich (bring|bringe|mach|mache|schlag|schlage|stech|steche|tote) (dich|euch)
je vais te (tuer|frapper|casser|crever)
te voy a (matar|pegar|romper)
(creve|stirb|verreck|muerete|muere)
(you|u|your kind|your lot|your {KIN}) {WANTED} (just|all|really)? (be {VIOLATED}|{SUFFER})
(you|u) (do not|don t|dont) deserve to (live|exist|breathe)
(you|u) (are|re) (dead|a dead man) (to me)? (if|when|you|{END})
{YOU} deserve (to be {VIOLATED}|to {SUFFER}|a bullet|death)
(put|plant|want to put) a (bullet|knife) (in|into|through) (you|your)
(beat|kick|knock|smash|punch|slap) the (living)? (crap|shit|hell|daylights|life|teeth) out of (you|u)
(gehorst|gehoren|gehort) (vergast|erschossen|erschlagen|kastriert|aufgehangt|verbrannt)
(bash|cave|kick|smash) (your|ur) (head|face|teeth|skull) in
"""),
    ("hateful", 0.95, """
(are|is|all|sind|sont|son|were|est|ist) (all|just|nothing but|like|de la|eine|la|lauter|alle|a bunch of|a|the)* {DEHUMANIZING}
{SORT} (are|is|sind|sont|son|were) (all|just|nothing but|like|a bunch of|des|de|lauter|unos|unas|filthy|dirty)* {BEASTS}
{CAP} (are|is|sind|sont|son|were) (all|just|nothing but|like|a bunch of|des|de|lauter|unos|unas|filthy|dirty)* (rats|savages|thieves|rapists|criminals|swine|leeches|liars|ratten|ratas)
(they|those people|these people) (are|re) (all|just|nothing but) {BEASTS}
(are|re) all (liars and thieves|thieves and liars)
(haben|hat) (hier|in . .) nichts zu suchen
das ist alles (ungeziefer|abschaum|dreck)
(breed|breeding|multiply) like (rats|rabbits|vermin)
(son|es) (la|una)? escoria
sobran en (este|esta|nuestro)
de la vermine
never hire .{1,3} they are
(get rid of|wipe out|exterminate|deport|round up|lock up|gas|ban|expel|eradicate|eliminate|sterilize|kill|murder|hang|lynch|shoot|burn|slaughter) {THOSE}* {SORT}
{MURDER} (all|all the|all of the|all those|all these|every) {CAP} ({END}|and|they|now)
(get rid of|wipe out|round up|ship off|throw out) {THOSE}* . (and)? (they ruin|and ship them)
and ship them (off|back|home)
{SORT} .{0,4} (must|should|ought to|deserve to|have to) (all|just)? be {VIOLATED}
{SORT} (control|run|own|rule) (everything|the media|the banks|the world|hollywood|the government)
(deport|exterminate|kill|shoot|gas|hang|expel) (all|every|each)? (last|single)? (one)? (of)? {THOSE}* {SORT}
go back to where you came from
go back to your own? country
(has|have|is) no (room|place) for {ALIEN} ({END}|here|in|and|on)
no room for . (here|in this)? {END}
typical {SORT}
typical {CAP} .{0,3} ({DEMEANED}|dishonest|greedy)
filthy and dishonest
(ruined|destroyed|infested|overrun|spoiled) by the? {ALIEN} (as|like|again|{END})
{ALIEN} (do not|don t|dont|will never) belong
better off (before they let .{1,3} in|without {ALIEN} ({END}|here|around))
(not|never) (review|read|accept|merge|trust) any? code from {ALIEN}
they are all (liars|thieves|criminals|stupid|animals|rapists|terrorists)
keep (the|those|all)? {ALIEN} away
(driven|thrown|kicked|chased) out of (this|the|our)
they ruin everything
{SORT} (are|is) (all|just|too|so|nothing but|a bunch of|like|all the same)* .? ({DEMEANED}|{DEMEANING}|{BEASTS}|{BAD}|inferior|dishonest|terrorists|evil|perverts|unnatural|dirty)
{SORT} (should not|shouldn t|must not|do not deserve to|don t deserve to|have no right to) (exist|breathe|vote|live|reproduce|breed|be here|be alive|be allowed)
(dirty|filthy|stinking|fucking|stupid|lazy|greedy|disgusting|goddamn|damn) ({GRP}|{SLUR})
get (out of|the hell out of|the fuck out of) (my|our) country
the only good {ALIEN} is a dead
{SORT} (spread|carry|bring) (diseases|disease|filth|crime|aids|lice)
(sale|sales|sucios|sucio|dreckige|dreckiger) {SORT}
(rentre|rentrez|retourne|retournez) chez (toi|vous)
(women|girls|females|{SORT}) (are|is) too . to .
hitler should have
as always with that sort
(every|each) single one of them {END}
{GRP} raus
{GRP} (dehors|fuera)
dehors les {GRP}
{THOSE}* {SORT} (should|must|ought to|need to|deserve to) (all|just)? (be)? ({VIOLATED}|banned|fired|{SUFFER}|leave|go home|disappear)
(people|folks|men|women|anyone|everyone|those|types|guys|freaks|vermin) (like|such as) (that|you|them|him|her|this|these|those) (should|must|deserve to|need to|ought to) (all|just|never|not)? (be)? (allowed to)? ({VIOLATED}|{SUFFER}|breed|exist|vote|live)
(they|them) (should|must|deserve to|ought to|need to) (all|just)? (be)? {VIOLATED}
(no|free of|rid of) {GRP} (allowed|here|in this|in our|on this)
i (hate|despise|can t stand|detest) (all|the|all the|those|these)* {SORT} ({END}|and|because|so|they|who)
they (smell|stink)
(refuse to|never|won t|not) . (anything|code|work) .{0,2} (with|from|by) {ALIEN} (they|{END}|and)
{GRP} (smell|stink|steal|lie|breed|ruin|destroy)
(women|girls|females|frauen|femmes|mujeres) (belong|should stay|should be|gehoren) (in the kitchen|at home|in die kuche|silent|barefoot)
(women|girls|females|{SORT}) (can t|cannot|can not|should not|shouldn t|will never) (code|program|think|be trusted|drive|write code|do math|be engineers|vote)
(white|black|asian|aryan|jewish) (power|trash|scum|vermin|genocide|supremacy) ({END}|now|forever)
(hitler was right|heil hitler|sieg heil|gas chambers for|back to the ovens)
"""),
    ("sexual", 0.9, """
{SEX}
erection
(want to|wanna|would love to|d love to|let me|going to|gonna|i ll|i will|can t wait to|dying to) {SEX_VERBS} (you|u|your|her|him) .{0,2} (all over|everywhere|over|naked|slowly|tonight|all night|lips|neck|body|ass|thighs|hard|deep|senseless)
(sit on (my|your|his|her) (face|lap|desk|dick|cock)|take off your (clothes|shirt|pants|panties|bra)|strip for me|bend over .? (desk|for me)|naked for me|thinking of you naked)
{SEX_VERBS} (on)? (my|his) .? {PRIVATE}
(want to|wanna|would love to|d love to|i d like to|let me|dying to|dreaming of|dream of) ({SEX_VERBS}|feel|feeling|touching|licking|kissing) (your|her|ur) .? {SENSUAL}
(suck|lick|stroke|touch|kiss|squeeze|grope|fondle|spank|grab|eat|rub|worship|smell) (your|her|ur) .? {PRIVATE}
(show|send|flash) (me|us) (your|ur|those|some) .? ({PRIVATE}|{SEX}|underwear|nude|naked)
(suck|blow|ride|fuck|finger|lick) (me|me off) ({END}|hard|now|baby|tonight|off|please)
(my|your|his|her) (hard|wet|throbbing|tight|juicy|big|huge|erect) {PRIVATE}
(hard|wet|horny) (for|thinking about|thinking of) (you|u|her|him)
(cum|came|come|jerk off|wank) (on|in|inside|all over|over) (you|your|her|his|my|me|their) .?
(moaned|moaning|moans) (as|while|when|softly|loudly|with|and|in)
(bare|naked|her|soft|heaving) breasts
hey sexy
(wanna|want to|let s|lets|should we) (hook up|fuck|bang|get naked|have sex|sleep together)
(have|having|had|has|want|wants|wanted) (hot|wild|rough|oral|anal)? sex
(explicit|sex|dirty|steamy) (story|scene|tape|chat|talk|fantasy)
what are you wearing
(you|me|her|him|us) all? naked
naked (on|in|with) (my|your|his|her|the bed|bed)
(touch|lick|suck|spank|undress|fuck|ride|taste) (them|me|you|her|him|my|your|it) .{0,3} (tonight|naked|hard|slowly|all night|everywhere|bed|cock|dick|ass|pussy|body)
(sexy|hot) (babe|body|baby|ass|legs|girl|picture|photo|pictures|photos|babes|girls)
(begged|begging) (him|her|me|you) to (take|fuck|touch)
(do to me|take me) (under|against)
send me? ({SEX}|naked|a nude|your {SEX}|sexy)
(pussy|cock|dick) (pic|pics|so|in|inside|hard|wet)
(sleep|spend the night|come home|go to bed) with me (tonight|baby|and)
roleplay as my
(ficken|nacktbilder|nacktfotos|geile titten|geile sau|geile maus|geil titten)
(baise moi|photo de toi nu|photo de toi nue|photos de toi nu|photos de toi nue|te veux nu|te veux nue|seins nus)
(follar|follamos|desnuda para mi|foto desnuda|fotos desnuda|fotos desnudas|foto desnudo|enviame fotos|chupame|chupamela)
schick mir {NAKED}
zieh dich aus
(get|kneel) (on your knees|down and suck)
(bend|bent|bending) (you|her|him) over
make (you|her|him) (scream|moan|beg|cum|squirt) (and|all|for|{END})
"""),
]

RULES: list[tuple[int, Node]] = []  # (number of the group, rule)
PARTS["END"] = ("sym", "$")
for _g, (_kind, _weight, _text) in enumerate(GRAMMAR):
    RULES += [(_g, parse(line, PARTS)) for line in _text.strip().splitlines()]

#: Reported speech: what somebody else said, or called somebody, is not said by the text.
REPORTED = [
    parse(x, PARTS) for x in """
{SOMEBODY} {NOTWHO}{0,1} {SAID} (me|us|him|her|them|someone|everyone|to me|to him|to her|to us|to them)? ,? (that|dass|que)? <{WORD}{1,}>
{SOMEBODY} {NOTWHO}{0,1} {WROTE} (me|us|him|her|them|someone|everyone|to me|to him|to her|to us|to them|below|above|there)? (,|that|dass|que) <{WORD}{1,}>
{SOMEBODY} {NOTWHO}{0,1} {WROTE} (me|us|to me|to us)? <(you|u|du|tu|ich|i) {WORD}{1,}>
(he|she|they|someone|somebody|er|sie|il|elle|el|ella|{CAP}) (has|had|have)? {CALLED} <{WORD}{1,}>
{CALLED} (me|him|her|us|them|someone|somebody|anyone|anybody|people|others|each other|another|my {WORD}|our {WORD}|the {WORD}|{CAP}) (a|an|such a|the|un|une|ein|eine|einen)? {FREE}{0,2} {INSULTS}
""".strip().splitlines()
]
#: What is denied, or said of oneself or of a thing.
DENIED = [
    parse(x, PARTS) for x in """
(i|me|my|myself|ich|je|j|yo) (feel|felt|am|was|m|look|looked|seem|bin|war|suis|soy|must be|must have been|have been|ve been|will be|ll be) ({FREE}{0,3} (like|being|as))? {PREDICATE} {INSULTS}
(^|,) {FREE}* <{BAD}> (i|that i|me|ich|je|yo) (was|am|feel|bin|war|suis|soy)
<{BAD}> of me
(this|that|the|these|those|dieser|diese|dieses|der|die|das|ce|cet|cette|le|la|este|esta|el|it) {WORD}{0,2} (is|was|s|are|ist|war|est|es|can be) (a|an|such a|a real|a total|ein|eine|un|une|una|so ein) {WORD}? <{BAD}> to {WORD}
<{BAD}> {THING}
{THING} {WORD}? (is|was|ist|est|es) (a|an|un|une|ein|una)? (real|total)? <{BAD}>
(you|he|she|they|we|it|du|tu|vous|ihr|er|sie|usted) n? {BE}? ((aren|isn|wasn|weren) t|arent|isnt|wasnt|werent|{NO}) {PREDICATE} {INSULTS}
no (eres|es|soy|sois|son) {PREDICATE} {INSULTS}
(you|he|she|they|we|nobody|no one) {WORD}? ({NO}|n t|t) {FREE}{0,3} (be|being|been|were|like|call {FREE}?|called {FREE}?|calling {FREE}?) {PREDICATE} {INSULTS}
(nobody|no one|niemand|personne|nadie) {FREE}{0,3} {INSULTS}
(nobody|no one|niemand|personne|nadie) {WORD}{0,2} (say|says|said|saying|think|thinks|thought|call|calls|called|calling|claim|claims|claimed|believe|believes|sagt|denkt|dit|pense|dice|piensa) ,? (that|dass|que)? (you|he|she|they|we|i|du|ihr|tu|vous)? {BE}? {PREDICATE} {INSULTS}
(not|never|isn t|aren t|don t mean|doesn t mean) {FREE}{0,2} {YOU} (are|re) {DEGREE}{0,3} <({DEMEANED}|{DEMEANING})>
(nobody|no one|niemand|personne|nadie) {WORD}{0,2} {WORD} ,? (that|dass|que)? {YOU} (are|re) {DEGREE}{0,3} <({DEMEANED}|{DEMEANING})>
{YOU} (are|re) (not|n t|never|no) {DEGREE}{0,3} <({DEMEANED}|{DEMEANING})>
""".strip().splitlines()
]
#: Insults in a row, as in a list of words.
LISTED = [parse("<({INS}|{SOFT}|{SEX}|{SLUR}) ((,|and|or|und|oder|et|ou|y|o)* ({INS}|{SOFT}|{SEX}|{SLUR})){1,}>", PARTS)]

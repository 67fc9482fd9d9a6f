"""Abusive, hateful and sexually explicit language (problem 10).

A lexicon of stems in three languages (and Russian in Latin letters), each in one or more classes, is one trie. Every
distinct token is run through it as a Levenshtein automaton of degree one, so misspelt, masked, spaced-out and
mixed-alphabet forms are caught. Classes rarely decide alone: a cue asks for classes that stand together within a few
words (a threat verb and the one addressed, a group and a dehumanising noun), and words that report or quote language
lower every cue near them. The weight of a cue starts at a fixed value and is moved by labelled samples, which also
name groups of people that the lexicon doesn't know.

One map over the scan; tokens repeat, so the automaton runs once per distinct token of a worker.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Word classes. "~" stands for an ending of up to four letters; other entries are whole words.
CLASSES = """
insult: идиот~ дебил~ урод уроды урода уродов уроду уродина уродище придур~ мудак~ мудил~ мудозвон~ ублюд~ недоум~ недонос~ кретин~ имбецил~ паскуд~ мразь мрази мразью мразота гнида гниды гнидой скотин~ сволоч~ подонок подонки падла падаль говнюк~ говноед~ дурак дура дураки дураков дурень дурачьё болван~ балбес~ остолоп~ тупица тупицы тупицей чмо чмошник~ лошара ничтожеств~ шлюх~ шалав~ потаскух~ проститутка пидор~ пидарас~ козлина выродок выродки дегенерат~ засран~ мерзавец мерзавцы мерзавцев негодяй негодяи подлец подлецы бездар~ бестолоч~ дармоед~ отморозок отморозки шваль быдло долбоёб~ еблан~ дебилоид~ олигофрен~ гандон~ гондон~ сучара сучка сучки
insult: idiot~ moron~ asshole~ arsehole~ scumbag~ imbecile~ bitch~ cretin~ dickhead~ dumbass~ jackass~ cunt~ motherfuck~ shithead~ dipshit~ fuckwit~ fuckhead~ retard~ whore~ slut sluts skank~ dimwit~ nitwit~ halfwit~ lowlife~ douchebag~ numbskull~ dumbfuck~ twat prick pricks wanker~ tosser~ bellend~ crackhead~
insult: arschloch arschlöcher vollidiot~ trottel wichser schlampe schlampen drecksack~ drecksau dreckskerl~ schwachkopf~ missgeburt hurensohn~ hure vollpfosten mistst~ mistkerl~ scheißkerl~ saukerl~ idioten depp~ dummkopf~ blödmann hohlkopf~ spasti spastis fotze~
obscene: хуй хуё хуя хуйня пизд~ ебан~ ёбан~ ебать ебал~ бляд~ блять заеб~ говн~ дерьмо дерьма жопа жопу жопе жопой fuck~ shit~ bullshit scheiß~ scheisse verfickt~
soft: козёл козел козлы козлов баран бараны овца скот скоты гад гады гадина сука суки суку осёл осел ослы свинья свиньи свиней крыса собака псина шавка червь червяк тварь твари тварей мусор клоун клоуны трус мошенник вор воры ничто пустышка ведьма змея bastard bastards scum swine pig pigs dog rat rats worm snake trash garbage loser losers jerk jerks clown clowns coward fool fools dunce crook sau schwein schweine hund penner versager feigling esel ratte wurm abschaum dreck
adj: тупой тупая тупые тупого тупых тупорыл~ безмозгл~ криворук~ косорук~ безрук~ бездарн~ никчёмн~ никчемн~ жалкий жалкая жалкие паршив~ поганый поганая поганые вонючий вонючая вонючие вонючих грёбан~ гребан~ долбан~ сраный сраная сраные глупый глупая глупые мерзкий мерзкая мерзкие stupid dumb worthless pathetic useless filthy disgusting stinking miserable rotten brainless braindead spineless clueless ugly idiotic moronic dumm dumme dummer dummes dummen blöd blöde blöder blöden doof doofe wertlos~ erbärmlich~ widerlich~ dreckig~ elende elender elendes hirnlos~ nutzlos~
you: ты тебя тебе тобой твой твоя твоё твое твоего твоей твои твоему твоим твою твоих вы вас вам вами ваш ваша ваше ваши вашего вашей вашу ваших you your yours you're you'd youre u ur yourself du dich dir dein deine deinen deinem deiner ihr euch euer eure
thou: ты тебя тебе тобой твой твоя твоё твое твоего твоей твои твоему твоим твою твоих you you're your du dich dir dein deine deinen deiner
religion: богу богам вера веры веру верой молится молятся молиться faith religion pray prays praying god gods glaube glauben gott betet beten
me: нам нас us uns я мне меня мной моё мое мой моя i i'm i'll i'd i've me my mine ich mich mir mein meine meinen
who: кто тот та этот эта эти этого автор проектировщик~ инженер~ прораб~ бригадир~ монтажник~ начальник~ заказчик~ подрядчик~ whoever who he she they him them those designer engineer foreman manager contractor guy wer der die dieser diese ingenieur~ planer chef bauleiter
cheat: money деньги geld
kill: убью убьём убьет прибью придушу задушу зарежу прирежу урою закопаю замочу порву застрелю пристрелю сожгу уничтожу раздавлю kill murder strangle stab shoot slit slaughter choke drown butcher umbringen umbring~ töten töte erschlagen erschlage erwürg~ erschieß~ abstech~
break: сломаю сломаем сломать переломаю переломать переломаем оторву оторвать оторвём выбью выбить разобью разбить вырву вырвать отрублю отрезать отрежу покалечу изобью избить бить break smash crush beat punch kick rip cut brech~ breche zerschlag~ verprügel~ schlag~ prügel~
body: руки рук ноги ног шею шея голову голова башку пальцы пальцев зубы кости рёбра ребра горло глотку морду морда рожу рожа лицо челюсть хребет hands legs arms neck skull face head fingers bones teeth throat jaw knees ribs hände finger knochen beine arme hals genick schädel zähne kehle fresse gesicht
die: сдох сдохни сдохните сдохнешь сдохнуть сдохнут сдохли подохни подохнешь подохнуть передохли передохнут передохните издохни умри умрите помри die dead drown hang rot choke verreck~ krepier~ stirb sterben verrotte~
rare_die: сгори повесься утопись провались сдохни сдохните сдохнешь подохни подохните издохни verrecke krepiere передохните
suffer: мёрзнут мерзнут замёрз~ замерз~ вымрут вымирает вымирают вымер~ страдают страдать голодают сгорят сгори сгорит провалил~ завалило утони утонут freeze starve burn suffer cancer erfrieren frieren erfriert verhungern verhunger~ leiden krebs рак
wish: чтоб чтобы пусть пускай надеюсь желаю let hope wish hoffe hoffentlich möge mögen soll sollen sollten lass lasst
away: пошёл пошел пошла пошли пошлите иди идите вали валите катись катитесь проваливай~ убирайся убирайтесь убираться отвали отвалите verpiss~ geh
hell: нахуй нахер хуй хер чёрту черту чертям жопу задницу hölle teufel
shut_up: заткнись заткнитесь заткни заткните захлопн~
worth: никто никому некому нахрен nobody noone niemand niemandem keiner keinem
need: нужен нужна нужны любит любят вспомнит заметит пожалеет заплачет плакать оплачет хватится miss missed misses need needs love loves care cares want wants remember mourn braucht vermisst liebt vermissen
waste: waste пустое зря verschwend~
space: space oxygen air skin место platz
birth: родила родился родилась рожала born birth geboren geworfen
stalk: живёшь живешь живёт живете live lives wohnst wohnt wohnen
know: знаю знаем вычислю узнаю найду найдём know find weiß weiss finde finden
locked: клетк~ cage cages käfig~ зоопарк~ психушк~ дурдом~ zoo asylum
keep: держать держи место сидеть запереть locked lock keep kept belong belongs gehör~ einsperr~ eingesperrt sperr~
group: мигрант~ приезж~ нацмен~ понаехав~ иммигрант~ беженц~ евре~ цыган~ мусульман~ таджик~ узбек~ киргиз~ кавказц~ азиат~ чеченц~ армян~ грузин~ украинц~ негр~ африканц~ китайц~ инвалид~ калек~ хромые хромых хромым слепые слепых глухие глухих старики стариков старикам старичьё старичье старух~ пенсионер~ баб бабы бабам бабами женщин~ девк~ геи геев геям гомосек~ лесбиян~ иностранц~ иновер~ неверующ~ верующ~ атеист~ христиан~ католик~ буддист~ горцы горцев горцам кочевник~ провинциал~ бомж~ бездомн~ чужак~
group: migrant~ immigrant~ refugee~ foreigner~ jew jews jewish muslim~ blacks arab arabs asian asians african~ mexican~ gypsy gypsies gay gays lesbian~ queers homosexual~ women woman females girls cripple~ elderly pensioner~ infidel~ unbeliever~ christian~ catholic~ hindu~ nomad~ highlander~ homeless
group: ausländer~ migrant~ flüchtling~ asylant~ juden muslime~ türken araber~ polen zigeuner~ schwarze schwarzen frauen weiber behindert~ krüppel rentner~ greise schwule~ lesben ungläubig~ christen nomaden bergvolk~ zugezogen~ obdachlos~
slur: чурк~ хач хачи хачей черномаз~ черножоп~ жид жиды жидов жидам пиндос~ хохл~ кацап~ узкоглаз~ nigger~ nigga~ kike~ chink~ faggot~ wetback~ raghead~ towelhead~ gook~ tranny trannies kanake~ neger judensau schwuchtel~ untermensch~
dehuman: паразит~ тараканы тараканов саранча отброс~ отребь~ отродь~ грязь мерзость обуза зараза вырожденц~ нелюд~ недочелов~ животные зверьё обезьян~ скот стадо чума vermin subhuman~ cockroach~ parasite~ filth scum animals apes monkeys plague pest pests leeches burden ungeziefer abschaum parasiten gesindel pack dreck ratten kakerlaken untermensch~ tiere affen pest крысы крысами rats
low: низш~ неполноценн~ недоразвит~ второсортн~ lower inferior lesser minderwertig~ niedere niederer
race: раса расы существа существо порода народ нация люди breed race species people rasse wesen menschen volk
human: люди людьми людей human humans people menschen
not: не нет нельзя ни not don't doesn't isn't aren't ain't never no cannot can't don dont kein keine keinen keinem nicht nie
deserve: достойн~ достоин заслужи~ заслужив~ недостойн~ deserve deserves deserved worthy verdien~ wert
let_in: пускать пустить впускать брать доверять allowed trust lassen trauen
expel: гнать выгнать прогнать выселить вышвырнуть выкинуть депортир~ изгнать убираться убирайтесь deport~ expel~ evict~ banish rid raus rausschmeiß~ rauswerf~ abschieb~ vertreib~ abgeschoben verschwinden
keep_off: keep send stay get home back off out домой дома доме обратно nachhause zurück heim
annihilate: истреб~ уничтож~ вешать давить расстрел~ перестрел~ перебить вырезать усыпл~ сжигать стрелять душить exterminat~ annihilat~ gassed hanged shot eradicat~ wiped wipe vergas~ ausrott~ aufhäng~ erschieß~ aufgehängt
all: все всех всем всю эти этих этим таких такие такими all every those these such alle allen diese diesen solche jeder
be: are is be were — это sind ist war waren
breeds: плодятся размножаются расплодились multiply breeding vermehren
kitchen: плиты кухне кухню кухни плите stove kitchen herd küche
stink: вонь вони воня~ смердят смердит stink stinks smell smells stinken stinkt
better: лучше чище cleaner better besser sauberer
without: без without ohne исчезли вымерли gone weg
mother: мать мама мамаша мать твою mother mom mutter
porn: порно~ порнух~ порнуш~ порнограф~ porn porno porns porno~ pornograph~ xxx
act: трахн~ трахать трахал~ выеб~ отыме~ отсоси отсосать отсосёшь дрочи~ мастурб~ оргазм~ cumshot~ orgasm~ masturbat~ horny ficken gefickt fick bumsen geil
oral: минет минета минеты минетом минеты blowjob blowjobs handjob handjobs
sex: секс сексом секса сексу интим sex
fuck: fuck fucking fucked screw bang shag
desire: хочу хотел хочется мечтаю желаю давай дай want wanna wants would i'd let's lets love will möchte will zeig show
breasts: сиськи сисек сиськами сисечки титьки tits boobs boobies titten
part: грудь груди попу попку попа задницу ягодицы член члена киску breasts breast butt booty cock dick pussy nipples arsch brüste busen
touch: потрогать трогать потискать лапать погладить гладить ласкать облизать облизал облизывать вылизать лизать целовать сосать touch grope fondle lick licking licked suck kiss caress rub anfassen lecken küssen streicheln blasen
undress: разденься раздевайся раздеть раздевай undress ausziehen
undress_sure: разденься раздевайся undress
clothes: одежду одежды трусы трусики бельё белье лифчик платье юбку clothes panties bra underwear kleider unterwäsche höschen aus
naked: голую голая голые голой голого обнажён~ обнажен~ раздетая раздетую раздетые naked nude topless nackt nackte nackter nackten
nudes: nudes nacktbild~ nacktfoto~ нюдс~
photo: фото фотки фотку фотографии снимки видео photo photos pics pictures video bilder fotos
sexy: красотка красотку красавица сладкая сладкий сладенькая киса детка honey sexy babe sweetie darling süße schatz
cum: кончу кончаю кончить cum cumming стонала стонать стонешь moan moaned moaning stöhn~
bed: постель постели кровать ночью ночь bed night bett nacht ложись коленях колени kneel knees
wait: жди приходи приезжай wait come warte komm
subj: ты вы you you're youre u du ihr
person: инженер проектировщик прораб бригадир монтажник начальник заказчик подрядчик директор автор мастер сметчик engineer designer foreman manager contractor boss client ingenieur planer chef bauleiter
kill_sure: убью зарежу придушу задушу урою пристрелю застрелю прирежу
wish_ill: hope wish чтоб чтобы надеюсь желаю hoffe hoffentlich wünsche
strong_dehuman: vermin subhuman~ ungeziefer abschaum gesindel нелюд~ отродь~ отребь~ вырожденц~ недочелов~
lick: облизать облизал облизывать вылизать лизать целовать ласкать lick licking licked kiss caress fondle lecken küssen streicheln
hunt: найду найдём вычислю
"""
# Cues. category | weight | reach | classes that must stand together, each at a place of its own, within that many words of the first;
# with ">" in this order, each within that many words of the one before. "/" parts alternatives, a word in quotes is itself, @end is the end of a clause.
CUES = """
abuse | 0.9 | 0 | insult
abuse | 0.8 | 2 | soft subj
abuse | 0.8 | 4> | "ты"/"du" soft
abuse | 0.8 | 4 | soft adj
abuse | 0.8 | 3 | soft insult
abuse | 0.8 | 7 | soft "тот" "кто"
abuse | 0.8 | 7 | soft "whoever"/"wer"
abuse | 0.8 | 7 | soft cheat
abuse | 0.8 | 5 | soft "only"/"только"/"nur" "would"/"мог"/"могли"/"could"/"könnte"/"kann"
abuse | 0.8 | 2 | soft "полный"/"полная"/"absolute"/"total"/"totaler"
abuse | 0.8 | 3> | subj adj @end/soft/obscene
abuse | 0.8 | 1> | adj person
abuse | 0.8 | 2> | adj "piece" obscene
abuse | 0.8 | 2> | "piece" obscene
abuse | 0.8 | 2> | subj obscene
abuse | 0.9 | 5 | kill you me/body
abuse | 0.8 | 2 | kill you
abuse | 0.6 | 0 | kill_sure
abuse | 0.8 | 6 | break you body
abuse | 0.8 | 5 | break body "мало"/"надо"/"i'll"/"werde"
abuse | 0.8 | 4 | "мордой"/"рожей" "стену"/"стол"/"об"
abuse | 0.9 | 0 | rare_die
abuse | 0.8 | 5 | die wish you/who/all
abuse | 0.7 | 2> | "чтоб" you
abuse | 0.8 | 2> | subj "dead"/"труп"/"покойник"/"tot" @end/"meat"/"man"/"if"
abuse | 0.8 | 2> | subj "dead"/"труп" who
abuse | 0.7 | 1> | "you're" "dead"
abuse | 0.8 | 5 | subj not "проснёшься"/"проснешься"/"проснулся"/"проснулась"/"доживёшь"/"доживешь"/"aufwachst"
abuse | 0.8 | 1> | "прибью"/"закопаю"/"замочу" @end/you
abuse | 0.8 | 6 | worth "find"/"found"/"найдёт"/"найдет"/"finden"/"findet" you
abuse | 0.8 | 8 | suffer wish_ill you/mother
abuse | 0.8 | 8 | suffer wish_ill "family"/"семья"/"kids"/"дети"/"familie"/"kinder"
abuse | 0.8 | 3> | die "hell"/"аду"/"hölle"
abuse | 0.8 | 2> | kill/die "yourself"/"dich"/"себя"
abuse | 0.8 | 3> | away thou/hell hell/@end
abuse | 0.8 | 2> | away "вон"/hell
abuse | 0.8 | 3> | "пошли"/"пошёл"/"пошел"/"убирайтесь"/"убирайся" "все"/"всё"/subj "вон"/"отсюда"
abuse | 0.8 | 2> | "go"/"geh"/"fahr" "hell"/"hölle"/"teufel"
abuse | 0.8 | 1> | "get" "lost" @end
abuse | 0.8 | 1> | "fuck"/"piss" "off"
abuse | 0.8 | 1> | "fuck"/"fick"/"screw" subj/"dich" @end
abuse | 0.8 | 1> | "leck" "mich"
abuse | 0.8 | 1> | "verpiss" "dich"
abuse | 0.9 | 0 | shut_up
abuse | 0.8 | 1> | "shut" "up" @end/you/insult
abuse | 0.8 | 2> | "shut" "your"/"the" "mouth"/obscene/"hell"
abuse | 0.8 | 2> | "halt"/"haltet" "dein"/"deine"/"die"/"das"/"eure" "maul"/"fresse"/"klappe"
abuse | 0.8 | 7 | worth need you
abuse | 0.8 | 4> | "waste" "of" space
abuse | 0.8 | 8 | birth mother thou
abuse | 0.8 | 6 | birth not subj
abuse | 0.8 | 4 | know "живёшь"/"живешь"/"живёте"/"wohnst"
abuse | 0.8 | 2> | "know" "where" subj stalk
abuse | 0.8 | 7 | hunt you break/kill/body
abuse | 0.8 | 8 | "find"/"finde" me you break/kill/body
abuse | 0.8 | 8 | locked keep subj/"тебя"/"вас"/"dich"/"таких"/"like"
abuse | 0.8 | 6 | locked "место"/"place"/"platz"/"belong"/"belongs"/"gehörst" thou
abuse | 0.8 | 4 | "пустое" "место" you
abuse | 0.8 | 5 | "crawl"/"уползай"/"kriech" "rot"/"die"/"сдохни"/"verrotte"
hate | 0.9 | 0 | slur
hate | 0.9 | 6 | group dehuman
hate | 0.7 | 3> | "all"/"все"/"alle"/"эти"/"these"/"diese"/"are"/"sind" strong_dehuman
hate | 0.7 | 3> | "are"/"sind" strong_dehuman
hate | 0.7 | 6 | "all"/"все"/"всех"/"alle" dehuman expel/annihilate
hate | 0.8 | 2> | low race
hate | 0.8 | 5 | group low
hate | 0.9 | 3> | group not human
hate | 0.8 | 6 | group not deserve
hate | 0.8 | 5 | group "недостойны"
hate | 0.8 | 8 | deserve not suffer
hate | 0.8 | 9 | "недостойны"/"недостойно" suffer
hate | 0.8 | 5 | group not let_in
hate | 0.8 | 8 | group expel
hate | 0.8 | 6 | group annihilate
hate | 0.8 | 5 | annihilate "таких"/"всех"/"them"/"alle" "надо"/"пора"/"must"/"muss"
hate | 0.8 | 8 | group suffer wish
hate | 0.8 | 5 | group die
hate | 0.8 | 5 | group kill
hate | 0.8 | 4 | group adj
hate | 0.8 | 4 | group insult
hate | 0.8 | 2 | group soft
hate | 0.8 | 4 | group obscene
hate | 0.8 | 6 | group kitchen
hate | 0.7 | 6 | group stink
hate | 0.8 | 6 | breeds dehuman
hate | 0.8 | 9 | group keep_off keep_off
hate | 0.8 | 6 | group not "место"/"platz"/"place"
hate | 0.7 | 8 | group better without
hate | 0.8 | 4 | "под" "нож" "всех"/"таких"/"их"
hate | 0.8 | 5 | "таких"/"них" "одна"/"одни" stink/dehuman/"разруха"/"вред"/"беды"
hate | 0.8 | 8 | religion expel
hate | 0.8 | 7 | "world"/"мир"/"welt"/"планета" better without
sexual | 0.8 | 6 | porn you/"watch"/"смотри"/desire/me/photo
sexual | 0.6 | 0 | porn
sexual | 0.9 | 4 | act you/me
sexual | 0.6 | 0 | act/oral
sexual | 0.8 | 6 | sex you me
sexual | 0.8 | 4 | sex "want"/"wanna"/"хочу"/"хочешь"/"möchte"
sexual | 0.8 | 4 | sex "займёмся"/"займемся"/"заняться"/"have"
sexual | 0.9 | 2> | desire fuck subj/"dich"
sexual | 0.8 | 4 | breasts you/me/"show"/"zeig"/"покажи"/touch
sexual | 0.9 | 5 | touch part you
sexual | 0.8 | 4 | touch part "дай"/"хочу"/"want"/"let"
sexual | 0.8 | 5 | lick you "body"/"тело"/"inch"/"всю"/"körper"/clothes/part
sexual | 0.9 | 6 | undress me/wait
sexual | 0.8 | 2 | undress_sure @end/you
sexual | 0.8 | 4 | "take"/"сними"/"снять"/"стянуть" clothes you/me
sexual | 0.8 | 2> | "zieh" "dich" "aus"
sexual | 0.8 | 3> | "take" "off" clothes
sexual | 0.8 | 3 | naked photo
sexual | 0.8 | 1> | subj naked
sexual | 0.8 | 2 | naked "тебя"/"dich"
sexual | 0.8 | 4 | naked me wait
sexual | 0.8 | 5 | "раздетая"/"раздетую"/"голая"/"голую" "смотри"/"глянь"/"покажись"/"хочу"
sexual | 0.8 | 6 | "body"/"тело"/"körper" you clothes
sexual | 0.8 | 5 | "сзади" "взял"/"возьму"/"брал"/"брали"/"брать" you/me/"как"
sexual | 0.8 | 3> | "take"/"took"/"taken"/"nehme"/"nahm" you/"me"/"dich"/"from" "behind"/"hinten"
sexual | 0.8 | 6 | me "get"/"getting"/"got" "hard" you
sexual | 0.8 | 5 | "стоит" "меня" "твоего"/"тебя"/"тебе"/"твой"
sexual | 0.9 | 0 | nudes
sexual | 0.8 | 6 | cum you me
sexual | 0.8 | 5 | cum "меня"/"me"/"мной"/"mich" bed/you
sexual | 0.7 | 5 | sexy naked/part/bed/photo
sexual | 0.8 | 4 | "kneel"/"колени"/"коленях"/"knie" "me"/"мной"/"mir" "before"/"передо"/"front"/"vor"
"""
INNOCENT = set(
    "дебит дебита дебиту урон уран сукно скотч гадать падал матч порт порог порты порто порта чёрт тварный modem motor butch batch witch pitch ditch brich titles tilts ticks print "
    "portion node nodes nodal идио титан титана фиксируется fix fixed fixes flick click lack luck look loses lose closer laser doser like link milk hell2 bord "
    "чудак чудака чудаки чудаков судак судака судаки будил будила будили судил судила судили нудил крыша крыла скаты скобы котел котёл котлы котлов барак бараки выводок выводки застанет застанут закупаю "
    "тупика ступица ступицы ступицей гнилой гнила регенерат регенератор регенератора регенераторы регенераторов болтанка болтанки дебитор дебитора дебиторы дебиторов дебиты дебитом дебите "
    "стены стена стене тепло теплу теплы найди зайду голый полые полую своим концу кончая белые полоса давать знать гнуть мешать решать кухня торец торцы торцев торцам торца далек далеко далёк "
    "верно верны низкие низкая выбирает выбирают треть родина ходила водила черта "
    "report reports reported reporter reporting bleed freed greed creed breeze beide right whereas whereby wherein wholes wholesale whose shore shores shoreline chore idiom idioms idiomatic boron "
    "birch birches pitched pitches pitching batched batches batching ditches botch hitch hitches regard regards regarding regarded regardless reward rewards rewarded rewarding poser lover loner leser löser losen losem "
    "brick bricks trick tricks price prices banker bankers tanker tankers walker walkers wander dance dances danced ounce spine shine swing twine books booms named baked kneed loaned chose bread bleak fifth passed massed "
    "reserve reserves dudes nudge corny horns mitten bitten kitten dicken nicken picken ticken genickt gepickt getickt verdeck verdeckt verdeckte verdeckten verrückt verrücken verrechnet verrechnen verrechnung "
    "chick chicken chickens chunk chunks chunky china chinese chino bitcoin mists moons morocco mormon mornings pores ports porto skunk slots shuts shank tossed trotter wandered whole picks scheint pronoun niger nigeria nigerian newer "
    "минут минута минуты минуту минуте минутой придумал придумать придумано отметка отметки отметку отметил относ относ отнести сутки суток суткам сутках druck latten matten hatten masse kasse tasse gasse nasse wegen lesen presse bleche teller heller wollen wollte wollten ".split()
)
# Words that tell of language, or of its removal, instead of using it.
REPORTING = set(
    "слово слова слову словом термин термина выражение выражения фраза фразу фразы оскорбление оскорбления ругательство ругательства модератор модератора цитата цитату удалил удалила удалено удалены заблокировал "
    "фильтр фильтра word words term phrase quote quoted quotes insult insults moderator moderators abusive remark remarks removed deleted filter filters filtered blocked blocks flagged banned "
    "wort wörter begriff zitat beleidigung gelöscht gesperrt".split()
)
#: What reporting words leave of a cue's weight, and how near they stand: in words, and in words where the cue is between quotation marks.
REPORTED, NEAR, NEAR_QUOTED = 0.3, 6, 12
#: A document is reported from this score.
THRESHOLD = 0.5
#: Labelled rows that a fit reads, at most (the smallest ids).
FIT_ROWS = 20_000
#: Samples that a cue's fixed weight counts for.
PRIOR = 6.0

# Cyrillic letters in Latin, digits and signs that stand for letters, letters that look alike.
_TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
_FOR = {"0": "оo", "3": "зe", "4": "чa", "6": "б", "1": "iил", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a"}
_TO_CYRILLIC = str.maketrans("aeopcyxkmtbhiu", "аеорсухкмтвнии")
_TO_LATIN = str.maketrans("аеорсухкмтвніο", "aeopcyxkmtbhio")
_IGNORED = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\ufe00-\ufe0f]")
_WIDE = re.compile("[\uff01-\uff5e\ufb00-\ufb06\U0001d400-\U0001d7ff\u0300-\u036f]")
_LONE = re.compile(r"(?<![^\W_])[^\W\d_][.\-_·*•\s][^\W\d_][.\-_·*•\s][^\W\d_](?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_](?:[.\-_·*•]|\s(?=[^\W\d_](?:[\s.!?,]|$)))){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:[*@#$%&'’0-9]+[^\W_]+)*[*@#$]*|[«»\"“”„]|[.!?\n,;:]")
_FOREIGN = re.compile(r"[^\x00-\x7fа-яёäöüßіјѕһο]")
_STRETCHED = re.compile(r"(.{1,2}?)\1{2,}")
_MASK = set("*@#$%&")
_CYR, _LAT = re.compile("[а-яё]"), re.compile("[a-zäöüß]")
_QUOTES, _STOPS = frozenset("«»\"“”„"), frozenset(".!?\n,;:")
#: Longest ending that an open stem takes, and after an edit.
_ENDING, _ENDING_NEAR = 4, 2


class Lexicon:
    """The trie with the stems of all classes and quoted words, each as a set of class bits, and the cues over those bits."""

    def __init__(self, groups: tuple[str, ...] = (), weights: dict[int, float] | None = None):
        self.root: dict = {}
        self.names: dict[str, int] = {"@end": 0}
        words: dict[str, int] = defaultdict(int)
        for line in CLASSES.strip().splitlines():
            name, listed = line.split(":", 1)
            for w in listed.split():
                words[w] |= self._bit(name)
        for w in groups:
            words[w] |= self._bit("group")
        self.cues: list[tuple[str, float, int, bool, tuple[int, ...]]] = []
        for k, line in enumerate(CUES.strip().splitlines()):
            category, weight, reach, terms = (x.strip() for x in line.split("|"))
            parts = tuple(self._part(t, words) for t in terms.split())
            self.cues.append((category, (weights or {}).get(k, float(weight)), int(reach.rstrip(">")), reach.endswith(">"), parts))
        self.alone = 0
        for _, _, _, _, parts in self.cues:
            if len(parts) == 1:
                self.alone |= parts[0]
        # classes that only stand beside others: a text without any other class has no cue
        light = ("you", "thou", "me", "who", "not", "all", "be", "subj", "keep", "keep_off", "human", "without", "better", "person", "know", "@end")
        self.heavy = ~sum(1 << self.names[n] for n in light)
        self.stems = dict(words)
        self.spelled = sum(1 << self.names[n] for n in ("insult", "obscene", "slur", "kill_sure", "rare_die", "act", "porn", "undress_sure", "shut_up"))
        for w, bits in words.items():
            self._add(w, bits, bool(bits & self.spelled))

    def _bit(self, name: str) -> int:
        return 1 << self.names.setdefault(name, len(self.names))

    def _part(self, term: str, words: dict[str, int]) -> int:
        bits = 0
        for alt in term.split("/"):
            if alt.startswith('"'):
                bit = self._bit(alt)
                words[alt.strip('"')] |= bit
            elif alt in self.names:
                bit = self._bit(alt)
            else:
                raise ValueError(f"no class {alt}")
            bits |= bit
        return bits

    def _add(self, word: str, bits: int, abusive: bool) -> None:
        stem, open_end = word.rstrip("~"), word.endswith("~")
        forms = {stem: len(stem), stem.replace("ё", "е"): len(stem)}
        if abusive and len(stem) >= 4 and _CYR.search(stem):
            # in Latin letters several become one, so an edit needs a longer stem
            forms |= {"".join(_TRANSLIT.get(c, c) for c in f): len(stem) - 2 for f in forms}
        for f, size in forms.items():
            node = self.root
            for c in f:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((bits, open_end, size))

    def exact(self, token: str) -> int:
        """The classes of a token as it is spelt."""
        node, bits, n = self.root, 0, len(token)
        for i, c in enumerate(token):
            node = node.get(c)
            if node is None:
                break
            for b, open_end, _ in node.get("", ()):
                if i == n - 1 or (open_end and n - i - 1 <= _ENDING):
                    bits |= b
        return bits

    def match(self, token: str) -> int:
        """The classes of the stems within the allowed distance of a token. Stems under five letters take no edit; from five on (six where
        the class is not abusive by itself) one letter may be inserted, left out or substituted, or two neighbours swapped; a masked letter
        is free, and so is a digit or sign that stands for a letter. The first letter stays. Words of their own at such a distance are in INNOCENT. An exact reading makes near ones void."""
        exact = near = 0
        n = len(token)
        stack = [(self.root, 0, 0, "")]
        seen: set[tuple[int, int, int]] = set()
        while stack:
            node, i, edits, _ = stack.pop()
            key = (id(node), i, edits)
            if key in seen:
                continue
            seen.add(key)
            rest = n - i
            for bits, open_end, size in node.get("", ()):
                if rest == 0 or (open_end and rest <= (_ENDING_NEAR if edits else _ENDING)):
                    if not edits:
                        exact |= bits
                    elif n >= 5:
                        near |= self._near(bits, size)
                elif rest == 1 and not edits and n >= 5:
                    near |= self._near(bits, size)
            if not rest:
                if not edits and n >= 5:
                    stack += [(child, i, 1, c) for c, child in node.items() if c]
                continue
            c = token[i]
            child = node.get(c)
            if child is not None:
                stack.append((child, i + 1, edits, c))
            if c in _MASK:
                stack += [(child, i + 1, edits, x) for x, child in node.items() if x]
                if i and token[i - 1] in _MASK:
                    stack.append((node, i + 1, edits, c))
            for x in _FOR.get(c, ()):
                child = node.get(x)
                if child is not None:
                    stack.append((child, i + 1, edits, x))
            if not edits and n >= 5 and i:
                stack.append((node, i + 1, 1, c))
                for x, child in node.items():
                    if x:
                        if x != c:
                            stack.append((child, i + 1, 1, x))
                        stack.append((child, i, 1, x))
                if rest > 1 and token[i + 1] != c:
                    child = node.get(token[i + 1])
                    child = child.get(c) if child else None
                    if child is not None:
                        stack.append((child, i + 2, 1, c))
        return exact or near

    def _near(self, bits: int, size: int) -> int:
        return bits if size >= 6 else bits & self.spelled if size >= 5 else 0


@dataclass(frozen=True)
class Fit:
    """What labelled samples add: names of groups, and the weights of cues; and ordinary words of the corpus that only look like a misspelt stem."""

    groups: tuple[str, ...] = ()
    weights: dict[int, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


class Scorer:
    """Scores of texts; one per worker."""

    MEMO = 300_000

    def __init__(self, fit: Fit | None = None):
        self.lex = Lexicon(fit.groups, fit.weights) if fit else lexicon()
        self.ordinary = INNOCENT | fit.ordinary if fit else INNOCENT
        self.clean: set[str] = set()
        self.known: dict[str, int] = {}

    def token(self, t: str) -> int:
        """The classes of a token; remembered."""
        known = self.known.get(t)
        if known is not None:
            return known
        if t in self.clean:
            return 0
        bits = self._token(t)
        if len(self.known) + len(self.clean) >= self.MEMO:
            self.clean.clear()
            self.known.clear()
        if bits:
            self.known[t] = bits
        else:
            self.clean.add(t)
        return bits

    def _token(self, t: str) -> int:
        # letters of further alphabets inside a word are noise
        w = _FOREIGN.sub("", t.strip("'’").replace("’", "'"))
        if len(w) > 20:
            w = _STRETCHED.sub(r"\1", w)
        if len(w) < 1 or w.isdigit() or w in self.ordinary:
            return 0
        if _CYR.search(w) and _LAT.search(w):
            cyrillic = w.translate(_TO_CYRILLIC)
            w = cyrillic if not _LAT.search(cyrillic) else w.translate(_TO_LATIN)
            if w in self.ordinary:
                return 0
        found = self.lex.match(w)
        if not found and (short := _STRETCHED.sub(r"\1", w)) != w:
            found = 0 if short in self.ordinary else self.lex.match(short)
        if not found and len(w) > 24:
            found = self._run_together(w)
        return found

    def _run_together(self, w: str) -> int:
        """The classes of the stems spelt out inside a long run of letters, where each is enough alone and has five letters or more."""
        bits = 0
        for i in range(len(w)):
            node, j = self.lex.root, i
            while j < len(w) and (node := node.get(w[j])) is not None:
                j += 1
                for b, _, size in node.get("", ()):
                    if size >= 5 and b & self.lex.alone:
                        bits |= b & self.lex.alone
        return bits

    def cues(self, text: str | None) -> dict[int, float]:
        """The cues that a text holds, each with the largest factor that reporting words leave it."""
        if not text:
            return {}
        if _IGNORED.search(text):
            text = _IGNORED.sub("", text)
        if _WIDE.search(text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower()
        if _LONE.search(text):
            text = _SPACED.sub(lambda m: re.sub(r"[.\-_·*•\s]", "", m.group()), text)
        tokens = _TOKEN.findall(text)
        every = 0
        for t in set(tokens) - self.clean:
            if t not in _STOPS and t not in _QUOTES:
                every |= self.token(t)
        if not every & self.lex.heavy:
            return {}
        every |= 1
        some = [(k, cue) for k, cue in enumerate(self.lex.cues) if all(every & p for p in cue[4])]
        if not some:
            return {}
        hits: list[tuple[int, int]] = []
        quotes: list[int] = []
        told: list[int] = []
        place, get = 0, self.known.get
        for t in tokens:
            if t in _STOPS:
                hits.append((place + 1, 1))
                place += 1 if t in ",;:" else 4
            elif t in _QUOTES:
                quotes.append(place)
            else:
                place += 1
                bits = get(t)
                if bits:
                    hits.append((place, bits))
                if t in REPORTING:
                    told.append(place)
        hits.append((place + 1, 1))
        held: dict[int, float] = {}
        for k, (_, _, reach, ordered, parts) in some:
            first = parts[0]
            for at, (p, bits) in enumerate(hits):
                if bits & first and held.get(k, 0.0) < 1 and (len(parts) == 1 or (_in_order if ordered else _around)(parts, hits, at, reach)):
                    quoted = sum(q < p for q in quotes) % 2 == 1
                    reported = any(abs(p - r) <= (NEAR_QUOTED if quoted else NEAR) for r in told)
                    held[k] = max(held.get(k, 0.0), REPORTED if reported else 1.0)
        return held

    def score(self, text: str | None) -> tuple[float, str | None]:
        """(score, category): the chance that any of the distinct cues found is right, and the category with the most weight."""
        held = self.cues(text)
        if not held:
            return 0.0, None
        by_category: dict[str, float] = {}
        miss = 1.0
        for k, factor in held.items():
            category, weight, *_ = self.lex.cues[k]
            miss *= 1 - weight * factor
            by_category[category] = by_category.get(category, 0.0) + weight * factor
        return round(1 - miss, 6), max(sorted(by_category), key=by_category.get)


def _in_order(parts: tuple[int, ...], hits: list[tuple[int, int]], at: int, reach: int) -> bool:
    """Whether the further parts follow the hit `at`, each within reach of the one before."""
    ends = {at}
    for part in parts[1:]:
        after = set()
        for e in ends:
            for j in range(e + 1, len(hits)):
                if hits[j][0] - hits[e][0] > reach:
                    break
                if hits[j][1] & part and hits[j][0] > hits[e][0]:
                    after.add(j)
        if not after:
            return False
        ends = after
    return True


def _around(parts: tuple[int, ...], hits: list[tuple[int, int]], at: int, reach: int) -> bool:
    """Whether the further parts stand within reach of the hit `at`, each at a place of its own."""
    p = hits[at][0]
    lo, hi = at, at
    while lo and p - hits[lo - 1][0] <= reach:
        lo -= 1
    while hi + 1 < len(hits) and hits[hi + 1][0] - p <= reach:
        hi += 1
    near = [j for j in range(lo, hi + 1) if j != at]

    def place(k: int, used: frozenset[int]) -> bool:
        return k == len(parts) or any(hits[j][1] & parts[k] and j not in used and place(k + 1, used | {j}) for j in near)

    return place(1, frozenset())


def fit_samples(rows: list[tuple[str | None, str | None]]) -> Fit:
    """The fit of (text, category) judgements, category none meaning harmless: each cue's weight becomes the share of the judgements of texts
    that hold it which call them anything but harmless, its fixed weight counting for PRIOR of them. Names of groups are words that stand beside
    a hateful predicate in texts judged hateful, that the lexicon doesn't know and that no harmless text holds."""
    votes: dict[str, list[str]] = defaultdict(list)
    for text, category in rows:
        if text and category:
            votes[text].append(category)
    scorer = Scorer()
    predicate = sum(1 << scorer.lex.names[n] for n in ("dehuman", "low", "human", "deserve", "let_in", "suffer", "annihilate"))
    every = 1 << scorer.lex.names["all"]
    harmless, hateful = Counter(), Counter()
    for text, cast in votes.items():
        words = set(re.findall(r"[^\W\d_]{4,}", text.lower()))
        if all(c == "none" for c in cast):
            harmless.update(words)
        elif all(c == "hate" for c in cast):
            # the subject comes first: the first word without a class, where the words after it carry some
            for sentence in re.split(r"[.!?\n]", _IGNORED.sub("", text.lower())):
                said = re.findall(r"[^\W\d_]+", sentence)
                subject = next((i for i, w in enumerate(said) if not scorer.token(w)), None)
                leads = subject == 0 or (subject == 1 and scorer.token(said[0]) & every)
                if leads and len(said[subject]) >= 4 and any(scorer.token(w) & predicate for w in said[subject + 1 : subject + 6]):
                    hateful[said[subject]] += 1
    groups = tuple(sorted({_stem(w) for w in hateful if w not in harmless}))
    lex = Lexicon(groups)
    probe = Scorer(Fit(groups))
    seen, wrong = Counter(), Counter()
    for text, cast in votes.items():
        for k in probe.cues(text):
            seen[k] += len(cast)
            wrong[k] += sum(c != "none" for c in cast)
    weights = {k: (PRIOR * lex.cues[k][1] + wrong[k]) / (PRIOR + seen[k]) for k in seen}
    return Fit(groups, {k: min(0.95, w) for k, w in weights.items()})


def _stem(word: str) -> str:
    """A word without its ending, open to others: two letters less from six on."""
    return f"{word[:-2]}~" if len(word) >= 6 else word


def fit(samples: DataFrame) -> Fit:
    """`fit_samples` of a table (sample_id, text, category); at most FIT_ROWS rows, the smallest ids, reach the driver. An empty table
    leaves the fixed weights."""
    rows = samples.where("text is not null and category is not null").orderBy("sample_id", "text", "category").limit(FIT_ROWS).select("text", "category").collect()
    return fit_samples([(r.text, r.category) for r in rows])


#: A word read as a misspelt stem is ordinary if it occurs in at least so many documents, and in more than all stems spelt right.
FREQUENT = 20


def ordinary_words(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    """Words one edit from an abusive stem that stand in more documents than all such stems spelt right: no misspelling is more frequent than the
    word. Counted over all documents; what reaches the driver lies within one edit of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, clean, seen = lexicon(), set(), Counter()
        kinds: dict[str, str] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                told = set()
                for w in set(re.findall(r"[^\W\d_]{5,}", t.lower())) - clean:
                    kind = kinds.get(w)
                    if kind is None:
                        right = lex.exact(w)
                        kind = "" if right & lex.spelled else w if not right and lex.match(w) & lex.spelled else None
                        if kind is None:
                            if len(clean) >= Scorer.MEMO:
                                clean.clear()
                            clean.add(w)
                            continue
                        kinds[w] = kind
                    told.add(kind)
                seen.update(told)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = {r.word: r.n for r in counts.where((F.col("n") >= FREQUENT) | (F.col("word") == "")).collect()}
    right = frequent.pop("", 0)
    return frozenset(w for w, n in frequent.items() if n > right)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fitted: Fit | None = None) -> DataFrame:
    """(id_col, source_col, score double, category string): every row once. Null and empty texts score 0 with a null category,
    null sources stay null, repeated rows stay repeated, other columns are left out. Without a fit the fixed weights hold."""
    id_type, source_type = docs.schema[id_col].dataType.simpleString(), docs.schema[source_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(fitted)
        for batch in batches:
            out = [scorer.score(t) for t in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.float64()), pa.array([c for _, c in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, source_col, "score", "category"])

    return docs.select(id_col, source_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, `{source_col}` {source_type}, score double, category string")


def rates(scored: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, documents, flagged, abuse, hate, sexual, rate): per source; documents without a source form one group."""
    flag = F.col("score") >= THRESHOLD
    of = lambda c: F.count_if(flag & (F.col("category") == c)).alias(c)
    per = scored.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("documents"), F.count_if(flag).alias("flagged"), of("abuse"), of("hate"), of("sexual"))
    return per.withColumn("rate", F.col("flagged") / F.col("documents"))

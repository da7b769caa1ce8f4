"""Labelled seed sentences for the abuse model: general vocabulary and sentence patterns from which training sentences are drawn.

Names of groups, people and places are drawn as invented syllables, so that the model learns what is said and not of whom.
"""

from __future__ import annotations

import random

PERSON = (
    "idiot moron imbecile cretin halfwit dimwit nitwit loser scumbag dirtbag lowlife leech coward fraud liar crook bastard bitch asshole arsehole jerk dumbass dunce buffoon creep degenerate retard maggot weasel worm swine sleazebag slimeball "
    "scoundrel douchebag prick cunt wanker twat whore slut parasite clown rat pig cockroach fool failure thief hag slob freak tramp snake simpleton numbskull bonehead blockhead airhead crybaby bootlicker psycho hypocrite ape donkey toad brat ogre rodent louse vulture gremlin troll knucklehead cockwomble pea-brain"
).split()
PEOPLE = "idiots morons losers scumbags lowlifes leeches cowards frauds liars crooks bastards assholes creeps degenerates retards maggots worms swine parasites clowns rats pigs vermin cockroaches fools thieves freaks snakes animals trash scum filth imbeciles hypocrites apes savages".split()
THING = ["waste of space", "waste of skin", "waste of oxygen", "piece of garbage", "piece of trash", "piece of filth", "piece of shit", "piece of dirt", "sack of garbage", "sack of shit", "heap of dirt", "excuse for a human", "disgrace to your family", "stain on this town"]
BAD = (
    "worthless pathetic disgusting filthy rotten stinking greedy lying ugly useless spineless miserable braindead stupid dumb vile nasty sick dirty cowardly repulsive revolting slimy crooked lazy fat brainless clueless moronic idiotic despicable "
    "wretched lousy crappy shitty fucking damned goddamn inbred two-faced hideous putrid gutless snivelling sorry smelly retarded arrogant incompetent toothless mangy"
).split()
WISH = [
    "drop dead", "go to hell", "burn in hell", "rot in hell", "go rot", "go die", "just die already", "i hope you die", "i hope you die slowly", "i hope you get cancer", "i hope you choke on it", "choke on it", "kill yourself", "go kill yourself", "hang yourself", "go hang yourself", "drink bleach", "go drown yourself", "jump off a bridge", "go jump off a roof",
    "jump in front of a train", "go play in traffic", "you deserve to die", "you deserve to suffer", "you deserve everything bad that happens to you", "i hope you suffer", "i hope you lose everything", "i hope your {place} burns down", "i hope your {place} burns down with you inside", "i hope somebody beats you up", "i hope a truck hits you", "may you rot", "may you lose everything you have", "do the world a favour and disappear", "do everyone a favour and die",
    "nobody would miss you", "no one would cry at your funeral", "the world would be better without you", "crawl back into the hole you came from", "crawl back under your rock", "shut your mouth for good", "shut your filthy mouth", "shut the fuck up", "i will dance on your grave", "someone should put you down", "you should have been drowned at birth", "get run over", "eat dirt and die", "go fuck yourself", "fuck off and die",
]
THREAT = [
    "i will kill you", "i am going to kill you", "i will kill you and your family", "i will break your {limb}", "i will break every bone in your body", "i will beat you up", "i will beat you to a pulp", "i will smash your face", "i will smash your {limb}", "i will smash your face in", "i will hurt you", "i am going to hurt you badly", "i will stab you", "i will shoot you", "i will cut your throat", "i will slit your throat", "i will strangle you", "i will burn your {place} down", "we will burn your {place} to the ground",
    "i know where you live", "i know where you live and where you park", "i know where your kids go to school", "your kids are not safe", "i know your address and i am coming", "i am coming for you", "we are coming for you tonight", "i will find you", "i will find out where you live", "watch your back", "watch your back on the way home", "better watch your back", "sleep with one eye open", "you are a dead man", "you are dead", "you will be dead by {day}", "you will not live to see {day}", "you will not make it to {day}", "you will bleed", "you will be bleeding",
    "you will pay with blood", "you will end up in hospital", "you will leave in an ambulance", "i will put you in the hospital", "i will put you in a coffin", "somebody is going to put you in the ground", "i will put a bullet in your head", "next time i bring a gun", "next time i bring a knife", "next time i come with a bat", "i am bringing friends and baseball bats", "i am bringing a knife", "next time i am bringing a gun", "next time i bring a bat", "wait until i get my hands on you", "i will make you regret it", "i will make you wish you were never born", "expect a brick through your window", "your windows will be smashed and you will be next", "i will throw acid in your face", "i will run you over", "someone should shoot you",
]
GROUP = "foreigners immigrants migrants refugees muslims jews christians hindus gays lesbians homosexuals blacks arabs asians mexicans africans gypsies women cripples natives outsiders newcomers settlers believers pagans queers".split() + ["women drivers", "deaf people", "blind people", "disabled people", "old people", "black people", "gay people", "people of that faith", "people from the south", "people from the east", "folks from the camps", "folks like them", "their kind", "those people", "people with that accent"]
DEMEAN = [
    "are vermin", "are animals", "are animals, all of them", "are subhuman", "are subhuman trash", "are parasites", "are a plague", "are a disease", "are cockroaches", "are rats", "are filth", "are scum", "are savages", "are criminals by nature", "are thieves, every one of them", "are thieves and liars", "are all rapists", "are too stupid to live", "are dirty and lazy", "are inferior", "are inferior to us", "are not real people", "are not human", "breed like rats", "stink", "stink and steal", "steal and stink, all of them",
    "ruin everything they touch", "are ruining this country", "are ruining this town", "belong in a cage", "belong in camps", "belong in the gutter", "should be wiped out", "must be wiped out", "should be exterminated", "should be shot", "ought to be shot", "should be gassed", "should be hanged", "should be deported", "should all be deported", "should be driven out", "should be driven out for good", "should be thrown out", "must be thrown out", "should be locked up", "should be sterilised", "should go back where they came from", "should never be allowed to vote", "should never be allowed to own anything",
    "should not be allowed to breathe the same air", "do not deserve to live", "do not deserve to breathe", "deserve to be beaten", "deserve to burn", "have no place here", "have no place among decent people", "must be kept away from our children", "have no soul", "cannot be trusted, it is in their blood", "have the brains of monkeys",
]
SEX = [
    "free porn videos of {hot} {body}", "watch {hot} {body} on webcam, uncensored", "hot {body} near you want sex tonight", "{hot} {body} in your area are waiting for you", "xxx movies with {hot} {body}, free access", "hardcore porn galleries, adults only", "uncensored hardcore clips, {n} new videos", "live sex cams with {hot} {body}", "live {hot} {body}, tokens from ${n}", "adult chat with {hot} {body}, first minutes free", "explicit pictures of {hot} {body}", "escort with {hot} body, full service, no limits", "escort girls, ${n} an hour, anything you want",
    "full nude massage with happy ending, ${n}", "meet {hot} {body} for sex tonight", "they want it rough and dirty tonight", "send me nudes, baby", "i want to fuck you all night", "i want to lick you all over", "he fucked her hard on the {place}", "she sucked his cock until he came", "she went down on him on the {place}", "she sucked him off in the {place}", "he came on her face", "he came inside her", "she spread her legs and moaned", "she moaned as he thrust deeper", "she rode him until he came", "he ripped off her panties and took her from behind", "her wet pussy", "his hard cock", "she touched herself while he watched",
    "she stripped naked and begged for more", "she begged him to take her on the {place}", "he unzipped his trousers and she swallowed it all", "they had sex on the {place} and filmed it", "her husband filmed while the neighbour fucked her", "he licked her until she came", "she had an orgasm on the {place}", "naked {body} doing everything you ask", "dripping wet {body} on cam, click here for explicit shows", "busty {body} show their tits", "{hot} {body} in lingerie ready for action, click now", "my horny neighbour wants you", "masturbating on camera for tips", "gang bang party videos free", "dirty talk with horny {body}", "meet {hot} {body} tonight, no strings attached", "{hot} {body} want it rough tonight", "escort service with {hot} {body}, ${n}", "escort, {hot} body, ${n} an hour", "{hot} {body} waiting on cam, click for explicit shows", "{hot} {body} on cam, xxx, explicit, click here", "my {hot} neighbour rides me every night", "my {hot} boss touches herself on the {place}",
]
HOT = "naked nude horny busty wet sexy hot dirty kinky slutty topless half-naked sweaty lusty steamy wild".split()
BODY = "women men girls housewives couples milfs teens babes ladies guys strippers wives singles escorts models neighbours students nurses".split()
#: The same in other languages; {name} is somebody's name.
FOREIGN = {
    "de": ["du bist ein idiot", "du dummes schwein", "du dreckige sau, halt die fresse", "halt die fresse, du arschloch", "verreck doch, du stück scheiße", "fick dich, du hurensohn", "du wertloser versager", "{name} ist ein widerlicher drecksack", "{name} ist ein schwein und gehört verprügelt", "ich bring dich um", "ich breche dir die beine", "ich weiß, wo du wohnst", "pass auf dich auf, ich finde dich", "ausländer raus", "ausländer sind ungeziefer", "die flüchtlinge sind parasiten", "migranten sind tiere und gehören weg", "die juden sind an allem schuld, weg mit ihnen", "man sollte sie alle vergasen", "dieses pack gehört weggesperrt", "geile nackte frauen, pornos gratis", "nackte frauen live vor der kamera", "heiße frauen wollen sex heute nacht", "ihr seid abschaum", "ihr verdient den tod", "hoffentlich brennt dein laden ab", "hoffentlich stirbst du bald", "ihr dreckigen ratten"],
    "es": ["eres un idiota", "eres un imbécil inútil", "cállate, hijo de puta", "vete a la mierda, cabrón", "eres una basura humana", "{name} es un cerdo asqueroso", "{name} es una rata inmunda", "te voy a matar", "te voy a romper la cara", "te voy a romper las piernas", "sé dónde vives", "ojalá te mueras", "ojalá se queme tu tienda", "muérete, asqueroso", "fuera los extranjeros", "los inmigrantes son una plaga", "los migrantes son animales", "los gitanos son ladrones, hay que echarlos", "los gays son una enfermedad", "hay que matarlos a todos", "esa gente no merece vivir", "mujeres desnudas y calientes, porno gratis", "vídeos porno gratis", "chicas calientes quieren sexo esta noche", "maldito ladrón, vas a pagar con sangre", "merecen arder todos", "puta de mierda", "son ratas asquerosas"],
    "fr": ["tu es un idiot", "espèce d'imbécile", "ferme ta gueule, connard", "va te faire foutre", "sale pute", "tu es une ordure", "{name} est un porc", "{name} est un abruti fini", "je vais te tuer", "je vais te casser la gueule", "je vais te casser les jambes", "je sais où tu habites", "j'espère que tu vas crever", "crève, sale ordure", "les étrangers dehors", "les immigrés sont des parasites", "les migrants sont des animaux", "ces gens sont de la vermine", "il faut tous les brûler", "les juifs sont des rats", "femmes nues et chaudes, porno gratuit", "vidéos porno gratuites", "filles chaudes pour sexe ce soir", "vous êtes des ordures", "vous méritez la mort", "bande de rats", "sale voleur, tu vas payer", "déchet humain"],
    "pl": ["jesteś idiotą", "ty świnio", "zamknij się, kurwo", "spierdalaj, śmieciu", "zdychaj", "mam nadzieję, że zdechniesz", "zabiję cię", "połamię ci nogi", "wiem, gdzie mieszkasz", "{name} to debil", "{name} to świnia i złodziej", "imigranci to pasożyty", "obcokrajowcy to zwierzęta, wynocha", "wyrzucić ich wszystkich", "oni nie zasługują na życie", "nagie gorące kobiety, darmowe porno", "filmy porno za darmo", "jesteście szczurami"],
    "ru": ["ты идиот", "ты тупая свинья", "заткнись, сука", "пошёл на хуй", "сдохни, тварь", "чтоб ты сдох", "я тебя убью", "я сломаю тебе ноги", "я знаю, где ты живёшь", "{name} дебил и урод", "{name} вор и свинья", "мигранты это паразиты", "иностранцы это животные, вон отсюда", "гнать их всех", "они не заслуживают жить", "голые горячие женщины, порно бесплатно", "порно видео бесплатно", "вы все крысы и мрази"],
    "vi": ["mày là đồ ngu", "đồ chó", "câm mồm, đồ khốn", "đồ rác rưởi", "chết đi", "tao sẽ giết mày", "tao sẽ đánh gãy chân mày", "tao biết mày sống ở đâu", "{name} là đồ ngu", "bọn nhập cư là ký sinh trùng", "bọn người nước ngoài là súc vật, cút đi", "đuổi hết chúng nó đi", "phụ nữ khỏa thân, phim sex miễn phí", "video sex nóng bỏng miễn phí", "đồ con lợn bẩn thỉu", "lũ chuột bẩn thỉu"],
    "zh": ["你是白痴", "你这个蠢猪", "闭嘴，废物", "去死吧", "你这个人渣", "我要杀了你", "我要打断你的腿", "我知道你住哪里", "{name}是个垃圾", "移民都是寄生虫", "外国人都是畜生，滚出去", "把他们都赶走", "他们不配活着", "裸体美女，免费色情", "免费色情视频", "性感辣妹今晚约炮", "你们都是老鼠", "不得好死"],
    "ja": ["お前は馬鹿だ", "黙れ、クズ", "死ね", "このゴミ野郎", "豚野郎", "殺してやる", "足を折ってやる", "お前の家は知っている", "{name}はクズだ", "移民は寄生虫だ", "外国人は動物だ、出て行け", "あいつらを追い出せ", "生きる価値がない", "裸の女性、無料ポルノ", "無料エロ動画", "熱い女が今夜待っている", "お前らはネズミだ", "消えろ、馬鹿"],
}
#: Ordinary sentences that share words with the above: reports, rules, trades, medicine, mild oaths, figures of speech, complaints.
ORDINARY = [
    "our policy forbids harassment, threats and insults", "abusive callers will be asked to leave", "staff may refuse service after threats or insults", "hate speech is not tolerated here", "the police arrested a man who threatened to kill a clerk", "the court heard that he called her a liar and a thief", "the article reports racist attacks on migrants", "the charity helps victims of sexual abuse", "training against sexual harassment at work", "the film is about a murderer and contains strong language", "in the play the villain swears to burn the village", "the novel tells of a coward who becomes a hero",
    "we kill cockroaches, rats and other vermin", "rats and mice are a plague in old cellars", "parasites of dogs and cats are treated here", "maggots in the bin are a sign of flies", "stink bugs breed under the {place}", "dead trees are cut down and hauled away", "trash and garbage are collected on {day}", "the pig roast starts at noon", "the worm farm is open to schools", "a snake at the zoo bit its keeper", "the clown and the donkey visit the children", "rotten wood is replaced", "the filthy {place} was cleaned in an hour", "ugly stains are removed", "shoot us an email", "kill the engine before opening the hood", "break a leg at the recital", "naked wires must be covered", "wet paint, do not touch", "strip the old varnish", "a stripper for old paint", "screw the plate to the wall", "choke valves and spark plugs",
    "sexual health screening is confidential", "ask about contraception and safe sex", "breast exams and cancer screening", "treatment of erectile problems", "painful intercourse can be treated", "the nurse explains the use of condoms", "the gynecologist sees patients on {day}", "penis and vagina are explained in the biology class", "nude paintings hang in the museum", "life drawing with nude models for art students", "couples massage for adults", "adult dental plans cost more than plans for children", "adults only after ten, because of the bar licence", "the hot tub holds four women or men", "hot women's boots at half price", "wild birds and sexy cars at the fair", "escort to your car after dark", "webcam of the harbour", "live music and new videos on {day}", "girls and boys learn to swim", "singles dance on {day}", "models of old ships",
    "damn good coffee", "this cake is to die for", "a killer deal", "i nearly died laughing", "stupidly good pizza", "bloody brilliant service", "hell of a good crew", "holy crap, that was fast", "what the hell, it works again", "i felt like an idiot for waiting so long", "my old boiler was a piece of junk", "my phone died", "they murdered the competition with that price", "drop dead gorgeous flowers", "wickedly funny staff", "insanely good noodles", "sick beats at the club", "the queue was insane", "crazy low prices", "hungry as a wolf", "worked like a dog all day", "i could kill for that soup", "burning up in summer, freezing in winter",
    "terrible service, i will not come back", "the staff was rude and the bill too high", "two stars, the repair failed after a week", "the waiter was slow and the soup cold", "i was annoyed by the noise", "lousy coffee, dirty table", "a waste of money", "they never called back", "the crew was late and lazy that day", "overpriced and useless advice", "worst haircut i ever had", "the owner refused a refund", "not recommended", "i am disappointed",
    "foreigners find forms in six languages", "immigrants and refugees get free advice", "we hire migrants and train them", "migrants sing in the choir", "gay couples order wedding cakes here", "women, gays, migrants, everyone is welcome", "the jewish bakery opens early", "muslim holidays are respected", "people of any faith may rent the hall", "deaf people can call by video", "blind people get a guide", "black people and their history in this town", "old people get a discount", "women drivers get a free check on {day}", "people from the south brought this recipe", "christians and hindus share the hall", "disabled people park at the door", "their kind of music is folk", "those people are my neighbours", "natives of this town know the mill",
    "i know where you can park", "we know where you live and deliver there", "i will find you a better price", "i am coming for lunch on {day}", "we will come for you at noon", "you will pay less", "you will be happy with it", "you deserve a break", "you deserve the best", "i hope you enjoy it", "i hope your {place} looks great", "may you have many happy years", "watch your step on the stairs", "watch your head", "sleep well", "i will break the news on {day}", "he broke his leg on the {place}", "bring a bat and a glove to the game", "put the lid on the coffin maker's display", "bring your kids", "your kids are safe with us", "shut the door", "shut off the main valve", "go to the back {place}", "go play outside, kids", "the roof burned down in 1990", "we will smash the old wall and haul it off", "crawl space cleaning",
    "she went down on her knees to look under the sink", "he came on time", "they came inside to get warm", "she rode the bus until the end", "he unzipped the tent", "he took her order from behind the counter", "she begged for more time", "they want it done by {day}", "the neighbour filmed the storm", "click here for opening hours", "free videos on garden care", "first {n} minutes are free", "no limits on refills", "tokens for the car wash from ${n}", "${n} an hour for repairs", "full service wash, ${n}",
    "call {name} for an appointment", "{name} has run the {place} since 1990", "ask {name} about prices", "hey {name}, thank you", "{name} is a great plumber", "{name} and the crew were friendly", "whoever answers the phone is kind", "the whole team did a wonderful job", "what a lovely {place}", "you are wonderful", "tell {name} i said hello", "they are friendly, all of them", "are reliable and honest", "should be open on {day}", "must be booked ahead", "have a place near the park", "are from this town", "prices are fair", "open from nine to five", "closed on {day}", "we repair the {place} within a day", "a free estimate for every job", "everyone in town knows the bakery", "this place hires students", "keep dogs out of the {place}", "no bicycles near the {place}, they block the way",
    "wir entfernen ratten und ungeziefer", "die werkstatt ist am {day} geschlossen", "ausländer und nachbarn sind willkommen", "fragen sie nach {name}", "ein schwein am spieß", "unser team ist freundlich und schnell", "rufen sie uns an", "eliminamos ratas y plagas", "los extranjeros son bienvenidos", "los inmigrantes reciben ayuda", "el taller cierra el domingo", "pregunte por {name}", "recogemos la basura y limpiamos", "nous éliminons les rats et les parasites", "les étrangers sont les bienvenus", "les migrants suivent des cours", "appelez {name}", "l'atelier est fermé le lundi", "usuwamy szczury i pasożyty", "obcokrajowcy są mile widziani", "zadzwoń do nas", "мы удаляем крыс и паразитов", "иностранцам помогаем с бумагами", "звоните нам", "chúng tôi diệt chuột", "khách nước ngoài được chào đón", "gọi cho chúng tôi", "我们清除老鼠和寄生虫", "欢迎外国客人", "请致电预约", "害虫を駆除します", "外国のお客様も歓迎します", "お電話ください",
    "kostenlose beratung", "parken gratis", "estacionamiento gratis", "presupuesto gratis", "parking gratuit", "devis gratuit", "darmowy parking", "wycena za darmo", "консультация бесплатно", "бесплатная парковка", "gửi xe miễn phí", "tư vấn miễn phí", "免费停车", "免费咨询", "免费报价", "駐車場無料", "相談は無料です", "送料無料",
    "die frauen im chor singen am {day}", "heiße suppe am abend", "las mujeres del barrio hornean pan", "sopa caliente cada noche", "les femmes du quartier", "une soupe chaude chaque soir", "gorąca zupa", "горячий суп", "các phụ nữ trong xóm", "热汤", "女性のお客様",
]
PLACE = "office yard kitchen roof porch garden boiler fence shop warehouse counter cellar van staircase house store car bar garage desk".split()
LIMB = "legs arms neck jaw nose fingers teeth knees ribs skull".split()
DAY = "monday tuesday wednesday thursday friday saturday sunday morning christmas".split()


def vocabulary() -> frozenset[str]:
    """Words a starred-out word may stand for."""
    return frozenset(PERSON + PEOPLE + BAD + HOT + "fuck fucking shit shitty cock pussy dick tits cum whore slut porn sex bitch cunt die kill rape naked".split())


def training_sentences(count: int, seed: int = 11) -> list[tuple[str, int]]:
    """About ``count`` labelled sentences (1: abusive, hateful or sexual), drawn from the patterns."""
    rnd = random.Random(seed)
    pick = rnd.choice
    syllables = "ba cor del fen gar hol is jun kal lor mar nor ost pel quin ras sel tor ul ven war yar zel".split()

    def invented(n: int) -> str:
        return "".join(pick(syllables) for _ in range(n))

    def name() -> str:
        return pick([f"{invented(2)} {invented(2)}", f"{invented(2)}", "the owner", "the boss", "the manager", "that man", "that woman", "the one at the desk"])

    def town() -> str:
        return pick([invented(3), "this town", "our town", f"port {invented(2)}"])

    def group() -> str:
        return pick(GROUP) if rnd.random() < 0.6 else pick(["", "the ", "those "]) + invented(2) + pick(["ans", "ians", "s", "ites"])

    def insult() -> str:
        return f"{pick(BAD)} {pick(THING) if rnd.random() < 0.15 else pick(PERSON)}"

    def fill(text: str) -> str:
        for slot, words in (("place", PLACE), ("limb", LIMB), ("day", DAY), ("hot", HOT), ("body", BODY)):
            while "{" + slot + "}" in text:
                text = text.replace("{" + slot + "}", pick(words), 1)
        return text.replace("{n}", str(rnd.randint(2, 900))).replace("{name}", name()).replace("{town}", town())

    direct = [
        lambda: f"you {insult()}", lambda: f"you {pick(PERSON)}", lambda: f"you are a {insult()}", lambda: f"you {pick(BAD)} {pick(PEOPLE)}", lambda: f"what a {insult()}", lambda: f"{name()} is a {insult()}", lambda: f"{name()}, what a {insult()}", lambda: f"you {insult()}, {pick(WISH)}", lambda: f"{pick(WISH)}, you {insult()}", lambda: pick(WISH), lambda: f"{name()}, {pick(WISH)}",
        lambda: f"tell {name()} this: {pick(WISH)}", lambda: f"a pack of {pick(BAD)} {pick(PEOPLE)}", lambda: f"all of you are {pick(PEOPLE)}", lambda: f"only a {insult()} works there", lambda: f"{pick(BAD)} {pick(PEOPLE)}, {pick(WISH)}", lambda: f"whoever works there is a {insult()}", lambda: f"whoever raised {name()} raised a {pick(PERSON)}", lambda: "dumb as a rock and ugly as hell, the lot of you", lambda: f"{name()} deserves to be spat on",
        lambda: pick(THREAT), lambda: f"{pick(THREAT)}, {name()}", lambda: f"{name()}, {pick(THREAT)}", lambda: f"{pick(THREAT)}, you {pick(PERSON)}", lambda: f"take your {pick(BAD)} {pick(PLACE)} and {pick(WISH)}", lambda: f"fuck you, {name()}", lambda: f"{name()} is dumber than dirt, a {pick(BAD)} {pick(PERSON)} who ought to be slapped",
    ]
    hate = [
        lambda: f"{group()} {pick(DEMEAN)}", lambda: f"no {group()} in my {pick(PLACE)}, they {pick(DEMEAN)}", lambda: f"they hire {group()}, who {pick(DEMEAN)}", lambda: f"keep {group()} out of {town()}, they {pick(DEMEAN)}", lambda: f"everyone knows that {group()} {pick(DEMEAN)}", lambda: f"i will not be served by {group()}, they {pick(DEMEAN)}", lambda: f"{group()} out of {town()}", lambda: f"once the last of the {group()} is gone we can breathe, they {pick(DEMEAN)}", lambda: f"{group()} {pick(DEMEAN)} and {pick(DEMEAN)}", lambda: f"in {town()} {group()} {pick(DEMEAN)}", lambda: f"the {pick(PLACE)} is full of {group()}, who {pick(DEMEAN)}", lambda: f"get rid of {group()}, they {pick(DEMEAN)}",
    ]
    # ordinary sentences about the same groups and people
    mild = [lambda: f"{group()} are welcome here", lambda: f"we help {group()} with forms", lambda: f"{group()} have lived in {town()} for years", lambda: f"{name()} opened the {pick(PLACE)} in {town()}", lambda: f"everyone in {town()} knows that {name()} is kind", lambda: f"they hire {group()} and train them", lambda: f"ask {name()} about the {pick(PLACE)}"]
    foreign = [x for xs in FOREIGN.values() for x in xs]
    out: list[tuple[str, int]] = []
    for _ in range(count):
        r = rnd.random()
        text, y = (pick(direct)(), 1) if r < 0.22 else (pick(hate)(), 1) if r < 0.34 else (pick(SEX), 1) if r < 0.42 else (pick(foreign), 1) if r < 0.5 else (pick(ORDINARY), 0) if r < 0.92 else (pick(mild)(), 0)
        text = fill(text)
        if rnd.random() < 0.3:  # amid other words
            text = text if rnd.random() < 0.5 else f"{text}, {pick(['and it shows', 'all of them', 'every one of them', 'as everyone knows', 'believe me', 'that is how it is', 'and nobody says it', 'since last year', 'and that is that'])}"
            text = f"{pick(['honestly', 'listen', 'well', 'hey', 'i said', 'note', 'again', 'by the way'])}, {text}"
        out.append((text, y))
    return out

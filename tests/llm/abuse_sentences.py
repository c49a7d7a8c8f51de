"""Sentences for the abuse grammar, written without looking at any table: 1 is a case, 0 is none. All were used in the end.

The second and the third part were held out first. Of the second the grammar then found 18 of 25 cases and flagged none of
24 others; of the third, meant to be harder, 9 of 25, and 2 of 25 others.
"""

KNOWN = """
1 I will murder you
1 kill all the Romani
1 people like that should be gassed
1 you worthless piece of crap
1 you are a complete nincompoop
1 suck my balls
1 Your mother should have swallowed you, you inbred swine.
1 Nobody would cry if you got hit by a bus.
1 Go play in traffic.
1 I swear I'll smash your teeth in if you touch my branch again.
1 Women can't code, they should stay in the kitchen.
1 Gays are disgusting and should be locked up.
1 We should deport every last one of those Muslims.
1 Show me your tits or I won't merge.
1 I want to feel your thighs around my head tonight.
1 You're such a pathetic little worm.
1 Only a brain-dead monkey would write this.
1 Do us all a favour and drop dead.
1 Shut your mouth, you ugly cow.
1 Du bist so dumm wie Brot, du Depp.
1 Ferme-la, espèce de crétin.
1 Eres un pedazo de mierda.
1 Jews control everything and must be exterminated.
1 you are too dumb to breathe
1 he is a subhuman piece of filth
1 I'm going to find you and break your legs.
0 He said you are an idiot and I asked him to stop
0 The old process must be killed before it hangs.
0 This function is stupid and useless, let's remove it.
0 I am an idiot, I forgot the semicolon.
0 Please kill all the zombie processes on host 3.
0 You are right, the parser is garbage.
0 She told me that I was a moron, which hurt.
0 The word "bitch" must be on the blocklist.
0 The master node shoots the other node in the head (STONITH).
0 You should execute the migration first.
0 What a stupid bug, sorry about that.
0 Women in the survey reported higher satisfaction.
0 The migrants table has a foreign key to countries.
0 You don't need to be a genius, and you are certainly not stupid.
0 We should drop all the foreign keys.
0 Sex: male, female, unknown.
0 The bare pointer is wrapped in a smart pointer.
0 Beat the cache by hashing your keys.
0 I could kill for a coffee right now.
0 You can hit the endpoint with curl.
0 The garbage collector will bury your objects.
0 My code is shit, I know.
0 They called him a coward in the press.
0 You need to strip the binary and then touch the file.
1 You are the dumbest person I have ever worked with.
1 I hope your whole family gets cancer.
1 What kind of moron pushes on a Friday?
1 Somebody should put a bullet in your head.
1 You filthy animal, stay away from my code.
1 Immigrants are parasites that live off our taxes.
1 All lesbians should be raped until they learn.
1 I'd love to lick your pussy.
1 Black people are just monkeys.
1 Hey baby, send me a picture of your boobs.
1 You're nothing but a lying sack of garbage.
1 Kill yourself, seriously.
1 You braindead clown, read the docs.
1 Get out of my country, dirty Arab.
1 I will come to your house and strangle you.
1 Blacks are criminals by nature.
1 Fuck you and your stupid review.
1 Halt dein Maul, du Idiot.
1 Va crever, sale pute.
1 Cállate, imbécil, nadie quiere oírte.
1 Go hang yourself, loser.
1 He wants to ride my cock all night.
1 You are a disgrace to this team and a useless human being.
1 Trans people are sick freaks and should not exist.
1 Listen here you little shit.
0 The reviewer wrote that you are useless, but nobody agrees.
0 Don't be afraid, nobody thinks you are an idiot.
0 This idiotic API returns null for empty lists.
0 I feel so stupid for missing that.
0 We kill the worker when it exceeds its memory limit.
0 Run the women's health survey import again.
0 The Muslim holiday calendar is missing in the locale data.
0 The abuse filter flags the phrase 'kill yourself'.
0 How do I stop the daemon from hanging?
0 The dog ate my homework and the cat broke the build.
0 Your test beats the baseline by ten percent.
0 That joke about dead code was funny.
0 You will hurt performance if you lock here.
0 Hit me up when you have reviewed it.
0 It would be a waste of time to rewrite this.
0 The French translation is missing a verb.
0 Dirty pages are flushed before the snapshot.
0 An executor died and its children were killed by the OOM killer.
0 The attacker could inject code; sanitize the input.
0 She was insulted online and reported the account.
0 The tongue and lips models need more polygons.
0 You look like you need a break.
0 I hate Mondays and this damn printer.
0 Masters and slaves were renamed.
0 Gay and lesbian users asked for an inclusive form.
1 You absolute waste of skin, go back to school.
1 Are you retarded or just pretending?
1 I'm gonna beat the crap out of you after work.
1 The only good Mexican is a dead one.
1 You smell like a sewer and code even worse.
1 Everyone on the team hates you, just quit.
1 Homosexuals deserve to be stoned.
1 My fantasy is you naked on my desk.
1 You must be the stupidest human alive.
1 Your kind makes me sick.
1 Go choke on a bag of dicks.
1 These refugees are nothing but thieves and rapists.
1 She's a dirty slut who sleeps with every manager.
1 If I ever see you I will stab you in the neck.
1 Chinese people spread diseases, keep them out.
1 What a bunch of pathetic losers you are.
1 Kneel down and suck it.
1 Jump in front of a train, you freak.
1 Ihr seid alle erbärmliche Versager.
1 Du gehörst vergast.
1 Sale arabe, rentre chez toi.
1 Te voy a matar, hijo de puta.
1 Women are too emotional to write software.
1 I'd bend you over and make you scream.
1 Hitler should have finished the job.
0 I was stupid enough to trust the cache.
0 Nobody said that you are stupid.
0 The user complained that the support agent was called a loser.
0 This regex matches insults such as moron, idiot and jerk.
0 The garbage you see in the log is binary data.
0 Kill the background job and start again.
0 A dead worker must not block its children.
0 Gay rights organisations publish their data as CSV.
0 African and Asian fonts need fallback glyphs.
0 You are a new contributor, welcome!
0 He is a master of his craft and beats everyone at chess.
0 I would love to see your benchmark.
0 You suck in data from the pipe and blow it out again.
0 Sexual harassment is forbidden by our code of conduct.
0 The naked eye cannot see this difference.
0 Do not shoot the messenger.
0 What a terrible idea to store passwords in plain text.
0 We should get rid of all the legacy endpoints.
0 The foreigner table stores guest workers by country.
0 The breast cancer dataset has 569 rows.
0 I'd hit that endpoint with more load.
0 You could end up hurting throughput.
0 My cat sat on my lap while I wrote this.
0 Their animals are tagged with RFID chips.
0 Strangely, your process dies after an hour.
"""



def sentences(text: str) -> list[tuple[bool, str]]:
    return [(line[0] == "1", line[2:]) for line in text.strip().splitlines()]
